"""Token-capped prefix of a filtered document stream.

Semantics: documents are read in order; those passing the filter are grouped into batches of
``batch_docs``; reading stops after the (full) batch in which the running token total reaches the
cap; the overshoot is trimmed so the total equals the cap exactly. Every document of the final
batch counts as kept, even those after the cap point (they contribute no tokens).

Plan: two running sums over the kept documents (rank and tokens, see ``order``), one scalar
aggregate to find the stop rank, then plain filters. No step collects documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.order import with_running_sums


@dataclass
class CapResult:
    docs: DataFrame       # kept docs: ord cols, kept_rank, batch, n_tokens, tokens_kept
    stats: DataFrame      # one row: docs_seen, docs_kept, docs_dropped, tokens, token_cap, hit_cap


def capped_prefix(stream: DataFrame, ord_col: str, passed: Column, n_tokens: Column,
                  token_cap: int, batch_docs: int, keep: list[str] | None = None,
                  n_buckets: int | None = None) -> CapResult:
    if token_cap < 1 or batch_docs < 1:
        raise ValueError("token_cap and batch_docs must be >= 1")
    keep = [c for c in (keep or []) if c != ord_col]
    s = stream.select(ord_col, *keep, passed.alias("_pass"), n_tokens.cast("bigint").alias("n_tokens"))
    kept = with_running_sums(s.where("_pass").drop("_pass"), [ord_col],
                             {"kept_rank": F.lit(1), "_cum": F.col("n_tokens")}, n_buckets=n_buckets)
    kept = kept.withColumn("_before", F.col("_cum") - F.col("n_tokens"))
    head = kept.agg(F.count(F.lit(1)).alias("k"),
                    F.min(F.when(F.col("_cum") >= token_cap, F.col("kept_rank"))).alias("r"),
                    F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total")).first()
    n_kept_all, stop_rank, total = int(head["k"]), head["r"], int(head["total"])
    B = batch_docs
    if stop_rank is None:                       # cap never reached: whole stream consumed
        last_batch = None
        docs_kept = n_kept_all
        broke = False
    else:
        last_batch = (int(stop_rank) - 1) // B
        docs_kept = min(n_kept_all, (last_batch + 1) * B)
        broke = (last_batch + 1) * B <= n_kept_all    # a full batch triggers the early stop
    batch = F.floor((F.col("kept_rank") - 1) / F.lit(B)).cast("bigint")
    docs = kept.withColumn("batch", batch)
    if last_batch is not None:
        docs = docs.where(F.col("batch") <= last_batch)
    docs = docs.withColumn(
        "tokens_kept",
        F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.lit(token_cap) - F.col("_before")))
        .cast("bigint")).drop("_cum", "_before")
    tokens = min(token_cap, total)
    if broke:
        star = kept.where(F.col("kept_rank") == docs_kept).select(ord_col).first()[0]
        seen_col = F.count(F.when(F.col(ord_col) <= F.lit(star), F.lit(1)))
        kept_seen = F.lit(docs_kept)
    else:
        seen_col = F.count(F.lit(1))
        kept_seen = F.lit(n_kept_all)
    stats = (s.agg(seen_col.alias("docs_seen"))
             .select(F.col("docs_seen").cast("bigint"),
                     F.lit(docs_kept).cast("bigint").alias("docs_kept"),
                     (F.col("docs_seen") - kept_seen).cast("bigint").alias("docs_dropped"),
                     F.lit(tokens).cast("bigint").alias("tokens"),
                     F.lit(token_cap).cast("bigint").alias("token_cap"),
                     F.lit(tokens >= token_cap).alias("hit_cap")))
    return CapResult(docs=docs, stats=stats)
