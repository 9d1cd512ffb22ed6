"""Streaming filter + tokenise + append until a token cap, raw text never stored.

Each micro-batch (``foreachBatch``) continues the batch-mode W2 rule with carried counters. Its
texts are gated and encoded once, by any encoder that gives pieces ``(shard, ord, piece, ids)``: the
trained vocabulary (``bpe.encode_pieces``) or bytes. Documents that pass get global ranks
``kept_so_far + local rank``, running token totals start at ``tokens_so_far``; once the cap is
reached the stop batch is fixed. When that batch of ``batch_docs`` kept documents is complete the
batch hook raises a flag, on which the run control stops the query, whatever its trigger: a stream
that never ends comes to an end at the cap. Pieces are written with their shard offsets
(``doc_tokens``) into a folder per epoch, overwritten if the epoch is replayed after a failure
(idempotent); no document is ever one array. The counters are saved per epoch next to the
checkpoint; each epoch starts from those of the epoch before it, so a replayed epoch counts its
rows once.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.operators.order import with_running_sums
from tessera.session import shared_dir
from tessera.streaming.common import run_until

Encoder = Callable[[DataFrame], DataFrame]  # (shard, ord, text) -> (shard, ord, piece, ids)


@dataclass
class CapState:
    kept: int = 0
    tokens: int = 0
    seen: int = 0
    dropped: int = 0
    stop_batch: int | None = None
    done: bool = False


class ProgressLog:
    """Keeps the observed metrics of every micro-batch (one small row each)."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def add(self, epoch: int, metrics: dict) -> None:
        self.rows.append({"epoch": epoch, **metrics})


def _load_state(spark, state_dir: str, before: int | None = None) -> CapState:
    """Counters after the last saved epoch (below ``before``, if given); new ones if none is saved.

    An epoch that runs again after a failure must not start from its own counters, which may have
    been saved before Spark committed it. Only a folder that does not exist yet means "none"."""
    path = spark._jvm.org.apache.hadoop.fs.Path(state_dir)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return CapState()
    saved = spark.read.schema("epoch long, state string").json(state_dir)
    if before is not None:
        saved = saved.where(F.col("epoch") < before)
    rows = saved.orderBy(F.desc("epoch")).limit(1).collect()
    return CapState(**json.loads(rows[0]["state"])) if rows else CapState()


def stream_capped(stream: DataFrame, ord_col: str, text_col: str, passed: Column, encode: Encoder, token_cap: int,
                  batch_docs: int, shard: str, name: str = "capped", checkpoint: str | None = None,
                  trigger: dict | None = None) -> tuple[str, CapState, ProgressLog]:
    """Run ``stream`` until the cap; the folder of ``(shard, ord, rank, piece, start, ids)``, the
    counters and the progress rows. ``trigger`` as for ``DataStreamWriter.trigger`` (default: what is
    there now)."""
    spark = stream.sparkSession
    ckpt = checkpoint or shared_dir(spark, f"ckpt-{name}-stream")
    out_dir, state_dir = f"{ckpt}/doc_tokens", f"{ckpt}/cap_state"
    state = _load_state(spark, state_dir)
    progress, complete = ProgressLog(), threading.Event()
    B = batch_docs
    src = stream.select(F.col(ord_col).alias("ord"), passed.alias("_pass"), F.col(text_col).alias("text"))

    def on_batch(bdf: DataFrame, epoch: int) -> None:
        vars(state).update(asdict(_load_state(spark, state_dir, before=epoch)))
        if state.done:
            complete.set()
            return
        obs = Observation(f"progress_{epoch}")
        b = bdf.observe(obs, F.count(F.lit(1)).alias("rows"))
        # one pass over the texts: pieces of the documents that pass, an EOS piece for each
        encoded = f"{ckpt}/encoded/epoch={epoch}"
        encode(b.where("_pass").select(F.lit(shard).alias("shard"), "ord", "text")).select("ord", "piece", "ids") \
            .write.mode("overwrite").parquet(encoded)
        pieces = spark.read.schema("ord %s, piece int, ids array<int>" % bdf.schema["ord"].dataType.simpleString()).parquet(encoded)
        kept = pieces.groupBy("ord").agg(F.sum(F.size("ids")).cast("bigint").alias("n_tokens"))
        k = with_running_sums(kept, ["ord"], {"rank": F.lit(1), "cum": F.col("n_tokens")})
        k = k.withColumn("rank", F.col("rank") + state.kept).withColumn("cum", F.col("cum") + state.tokens)
        k = k.cache()
        head = k.agg(F.min(F.when(F.col("cum") >= token_cap, F.col("rank"))).alias("r")).first()
        if state.stop_batch is None and head["r"] is not None:
            state.stop_batch = (int(head["r"]) - 1) // B
        emit = k
        if state.stop_batch is not None:
            emit = emit.where(F.floor((F.col("rank") - 1) / B) <= state.stop_batch)
        before = F.col("cum") - F.col("n_tokens")
        emit = emit.select("ord", "rank", before.alias("before"), F.greatest(F.lit(0), F.least(
            F.col("n_tokens"), F.lit(token_cap) - before)).alias("tokens_kept"))
        within = Window.partitionBy("ord").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        at = F.coalesce(F.sum(F.size("ids")).over(within), F.lit(0))
        room = F.greatest(F.lit(0), F.col("tokens_kept") - F.col("at")).cast("int")
        placed = pieces.withColumn("at", at).join(emit, "ord").select(
            F.lit(shard).alias("shard"), "ord", "rank", "piece", (F.col("before") + F.col("at")).alias("start"),
            F.slice("ids", F.lit(1), room).alias("ids"))
        placed.where(F.size("ids") > 0).write.mode("overwrite").parquet(f"{out_dir}/epoch={epoch}")
        stats = emit.agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"),
                         F.coalesce(F.sum("tokens_kept"), F.lit(0)).alias("t")).first()
        complete_rank = None if state.stop_batch is None else (state.stop_batch + 1) * B
        if complete_rank is not None and stats["last"] is not None and int(stats["last"]) >= complete_rank:
            star = k.where(F.col("rank") == complete_rank).select("ord").first()[0]
            seen_here = bdf.where(F.col("ord") <= star).count()
            state.done = True
        else:
            seen_here = int(obs.get["rows"])
        state.seen += seen_here
        state.kept += int(stats["n"])
        state.dropped = state.seen - state.kept
        state.tokens += int(stats["t"])
        k.unpersist()
        spark.createDataFrame([(epoch, json.dumps(asdict(state)))], "epoch long, state string") \
            .write.mode("overwrite").json(f"{state_dir}/e={epoch}")
        progress.add(epoch, {"seen": state.seen, "kept": state.kept, "dropped": state.dropped,
                             "tokens": state.tokens, "cap": token_cap})
        if state.done:
            complete.set()

    if not state.done:
        run_until(src.writeStream.foreachBatch(on_batch), ckpt, complete.is_set, trigger)
    return out_dir, state, progress


def stats_frame(spark, state: CapState, token_cap: int) -> DataFrame:
    """The A2 counters of a finished run as a one-row DataFrame."""
    return spark.createDataFrame(
        [(state.seen, state.kept, state.dropped, state.tokens, token_cap, state.tokens >= token_cap)],
        "docs_seen bigint, docs_kept bigint, docs_dropped bigint, tokens bigint, token_cap bigint, hit_cap boolean")
