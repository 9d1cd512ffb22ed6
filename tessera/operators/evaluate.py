"""Evaluation of a validation shard.

The reference scores windows with a neural model. We keep its aggregation (token-weighted mean
loss, perplexity ``exp(min(loss, 100))``, batch cap) and supply the per-token loss from a smoothed
bigram model fitted on the training split (A12). Scores are for token t+1 given t, over true token
counts (the reference's double label shift is not reproduced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import filters, shards
from tessera.operators import windows as W
from tessera.operators.keys import join_null_safe, small


def perplexity(loss: Column) -> Column:
    """P17."""
    return F.exp(F.least(loss, F.lit(100.0)))


def chunk_pairs(chunks: DataFrame, limit: Column | None = None) -> DataFrame:
    """Adjacent token pairs ``(shard, prev, next)`` of a chunked shard, including pairs that span
    two chunks (each chunk's last id meets the next chunk's first id through a groupBy, not a join).
    With ``limit``, a column of the chunks, only the pairs whose first token stands before it; chunks
    behind it are dropped before anything is exploded.
    """
    if limit is not None:
        chunks = chunks.withColumn("_limit", limit).where(F.col("start") <= F.col("_limit"))
    arr = F.col("ids")
    n = F.size(arr) - 1
    if limit is not None:
        n = F.least(n.cast("bigint"), F.col("_limit") - F.col("start")).cast("int")
    n = F.greatest(n, F.lit(0))
    inner = chunks.select("shard", F.explode(F.arrays_zip(
        F.slice(arr, 1, n).alias("prev"), F.slice(arr, 2, n).alias("next"))).alias("p")) \
        .select("shard", "p.prev", "p.next")
    last = F.element_at(arr, -1)
    if limit is not None:
        last = F.when(F.col("start") + F.size(arr) - 1 < F.col("_limit"), last)
    edges = chunks.select("shard", F.explode(F.array(
        F.struct(F.col("chunk_id").alias("k"), F.element_at(arr, 1).alias("first"),
                 F.lit(None).cast("int").alias("last")),
        F.struct((F.col("chunk_id") + 1).alias("k"), F.lit(None).cast("int").alias("first"),
                 last.alias("last")))).alias("e")).select("shard", "e.*")
    cross = edges.groupBy("shard", "k").agg(F.max("last").alias("prev"), F.max("first").alias("next")) \
        .where(F.col("prev").isNotNull() & F.col("next").isNotNull()).select("shard", "prev", "next")
    return inner.unionByName(cross)


def bigram_counts(train_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A12 fit, a model per shard: pair counts ``(shard, prev, next, c)`` and context counts
    ``(shard, prev, cp)``."""
    pc = chunk_pairs(train_chunks).groupBy("shard", "prev", "next").agg(F.count(F.lit(1)).alias("c"))
    return pc, pc.groupBy("shard", "prev").agg(F.sum("c").alias("cp"))


def evaluate(train_chunks: DataFrame, val_chunks: DataFrame, val_meta: DataFrame, context: int,
             vocab_size: int, batch_size: int = 4, max_batches: int | None = None,
             alpha: float = 1.0, suffix: str | None = None,
             fitted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """One row per shard of ``val_chunks``: mean loss, perplexity, tokens and batches of
    its sequential windows under a bigram model of ``train_chunks`` (or its counts ``fitted``). With ``suffix`` each validation
    shard is scored by the model of the shard it was cut from (see ``shards.split_chunks``), else by
    one model of all training chunks.

    The windows follow one another without gaps, so the scored pairs are those whose first token
    stands before the end of the last window: they are counted per ``(prev, next)`` straight from the
    chunks (partial aggregate), no window is built, and chunks behind the last batch are not read
    further. The join with the model never sees one row per token, and a frequent pair is one row."""
    filters.check_context(context)
    n_windows = W.n_eval_windows(F.col("tokens"), context)
    if max_batches is not None:
        n_windows = F.least(n_windows, F.lit(max_batches * batch_size))
    meta = small(val_meta.select("shard", n_windows.alias("_nw")).where("_nw > 0"), "val_windows")
    pairs = chunk_pairs(join_null_safe(val_chunks, meta, ["shard"]), F.col("_nw") * context) \
        .groupBy("shard", "prev", "next").agg(F.count(F.lit(1)).alias("n"))
    one = F.lit(None).cast("string")
    model = one if suffix is None else shards.base_name(F.col("shard"), suffix)
    pc, cc = [t.withColumn("model", one if suffix is None else F.col("shard")).drop("shard") for t in fitted or bigram_counts(train_chunks)]
    if suffix is None:  # one model of all training shards
        pc = pc.groupBy("model", "prev", "next").agg(F.sum("c").alias("c"))
        cc = cc.groupBy("model", "prev").agg(F.sum("cp").alias("cp"))
    pairs = pairs.withColumn("model", model)
    j = join_null_safe(join_null_safe(pairs, pc, ["model", "prev", "next"], "left"), cc, ["model", "prev"], "left")
    p = (F.coalesce(F.col("c"), F.lit(0)) + alpha) / (F.coalesce(F.col("cp"), F.lit(0)) + alpha * vocab_size)
    tot = j.groupBy("shard").agg(F.sum(F.col("n") * -F.log(p)).alias("_s"), F.sum("n").alias("_t"))
    nb = meta.select("shard", F.ceil(F.col("_nw") / batch_size).cast("bigint").alias("n_batches"))
    loss = F.col("_s") / F.col("_t")
    return join_null_safe(tot, nb, ["shard"]).select(
        "shard", loss.alias("val_loss"), perplexity(loss).alias("val_ppl"),
        F.col("_t").cast("double").alias("val_tokens"), "n_batches")


def check_tokens(summary: DataFrame) -> list[dict]:
    """fail when an evaluated shard produced zero tokens (one row per shard comes back)."""
    rows = [r.asDict() for r in summary.collect()]
    if not rows or any(not r["val_tokens"] for r in rows):
        raise RuntimeError("no tokens were evaluated")
    return rows
