"""Stream state as tables by epoch, without a Python call per key.

Each micro-batch is an ordinary batch job (``foreachBatch``): partial aggregates inside the batch,
then one join with what earlier epochs left. An epoch writes its own folder and reads those of the
epochs before it, so one that runs again after a failure overwrites its rows and changes nothing
else. A hot key is aggregated before it is shuffled, or numbered in buckets, never held by one task.

The price is that a trigger reads the keys of the epochs before it (D3: 40 bytes a digest; T5: one
row per key in a snapshot and what came since; T6: a tail of rows per key and epoch), so triggers should be large, as those of bulk
ingestion are. ``horizon`` bounds the epochs that D3 and T6 look back to, which lets old state go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.timecols import epoch_seconds
from tessera.operators.keys import join_null_safe
from tessera.operators.materialize import materialize
from tessera.operators.order import with_ordinal
from tessera.session import shared_dir
from tessera.streaming.common import run_available

#: Epochs after which the counts of all keys are written in one piece.
SNAPSHOT_EVERY = 16
#: Rows of a sequence that one window of T6 covers.
BLOCK_ROWS = 1 << 16


def _each_epoch(stream: DataFrame, name: str, checkpoint: str | None, step: Callable[[DataFrame, int, str], None]) -> str:
    """Run ``step(batch, epoch, folder)`` for every micro-batch; the folder."""
    ckpt = checkpoint or shared_dir(stream.sparkSession, f"ckpt-{name}")
    run_available(stream.writeStream.foreachBatch(lambda batch, epoch: step(batch, epoch, ckpt)), name, stream.sparkSession, ckpt)
    return ckpt


def _before(spark: SparkSession, folder: str, schema: str, epoch: int, first: int = 0) -> DataFrame:
    """Rows that the epochs from ``first`` up to ``epoch`` wrote into ``folder``; other folders are not read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    table = spark.read.schema(f"{schema}, epoch long").parquet(folder)
    return table.where((F.col("epoch") >= first) & (F.col("epoch") < epoch)).drop("epoch")


def online_dedupe(stream: DataFrame, text_col: str = "text", ord_col: str = "ord", name: str = "dedupe",
                  checkpoint: str | None = None, horizon: int | None = None) -> str:
    """D3: folder of the rows that survive, with ``sha1``: of each digest the earliest row, by
    ``ord_col``, of the first epoch that has it. With ``horizon``, digests that no survivor of the
    last ``horizon`` epochs has count as new."""
    spark = stream.sparkSession
    cols = [c for c in stream.columns if c != text_col]
    s = stream.where(T.has_content(text_col)).select(*cols, T.canonical_text(text_col).alias(text_col))
    s = s.withColumn("sha1", T.digest(text_col))

    def step(batch: DataFrame, epoch: int, ckpt: str) -> None:
        row = F.struct(*[c for c in batch.columns if c != "sha1"])
        first = batch.groupBy("sha1").agg(F.min_by(row, F.col(ord_col)).alias("r")).select("sha1", "r.*").select(*batch.columns)
        seen = _before(spark, f"{ckpt}/kept", "sha1 string", epoch, 0 if horizon is None else max(0, epoch - horizon))
        first.join(seen, "sha1", "left_anti").write.mode("overwrite").parquet(f"{ckpt}/kept/epoch={epoch}")

    return _each_epoch(s, name, checkpoint, step) + "/kept"


def quota(stream: DataFrame, key: str, ts_col: str, id_col: str, max_req: int = 60, name: str = "quota",
          checkpoint: str | None = None) -> str:
    """T5: folder of ``(id, key, accepted)``: the first ``max_req`` requests of a key are accepted,
    by time and id within an epoch, epoch by epoch. Rows of a null key are one key."""
    spark = stream.sparkSession
    kind = stream.schema[key].dataType.simpleString()
    s = stream.withColumn("_t", epoch_seconds(stream, ts_col)).select(key, "_t", id_col)
    schema = f"`{key}` {kind}, n long"

    def step(batch: DataFrame, epoch: int, ckpt: str) -> None:
        # whole snapshots every SNAPSHOT_EVERY epochs: the last one, and the counts that came after
        last = epoch // SNAPSHOT_EVERY * SNAPSHOT_EVERY
        old = _before(spark, f"{ckpt}/all", schema, last + 1, last)
        if epoch == last and epoch:
            since = _before(spark, f"{ckpt}/counts", schema, epoch, last - SNAPSHOT_EVERY)
            whole = _before(spark, f"{ckpt}/all", schema, last - SNAPSHOT_EVERY + 1, last - SNAPSHOT_EVERY).unionByName(since)
            whole.groupBy(key).agg(F.least(F.sum("n"), F.lit(max_req)).alias("n")) \
                .write.mode("overwrite").parquet(f"{ckpt}/all/epoch={epoch}")
            old = _before(spark, f"{ckpt}/all", schema, last + 1, last)
        prior = old.unionByName(_before(spark, f"{ckpt}/counts", schema, epoch, last)).groupBy(key).agg(F.sum("n").alias("_n"))
        rows = with_ordinal(batch, ["_t", id_col], "_rn", partition_by=[key])
        rows = join_null_safe(rows, prior, [key], "left")
        rows.select(id_col, key, (F.col("_rn") + F.coalesce("_n", F.lit(0)) <= max_req).alias("accepted")) \
            .write.mode("overwrite").parquet(f"{ckpt}/answers/epoch={epoch}")
        batch.groupBy(key).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{ckpt}/counts/epoch={epoch}")

    return _each_epoch(s, name, checkpoint, step) + "/answers"


def diagnostics(stream: DataFrame, key: str, pos: str, token: str, entropy: str, n_gram: int = 3, entropy_window: int = 20,
                repeat_window: int = 64, name: str = "diagnostics", checkpoint: str | None = None,
                horizon: int | None = None, block_rows: int = BLOCK_ROWS) -> str:
    """Folder of ``(key, pos, avg_entropy, repeated)``: the mean of a sequence's last
    ``entropy_window`` entropies, and whether its newest n-gram stood in its last ``repeat_window``
    tokens before.

    A sequence's rows are in order of ``pos`` within an epoch, epoch by epoch. An epoch leaves each
    sequence's last rows as its tail; the next one that has the sequence numbers its rows behind
    them. Windows cover blocks of ``block_rows`` rows and what the first of them look back to, so a
    long or busy sequence lies in many tasks. With ``horizon``, a sequence that none of the last
    ``horizon`` epochs had begins anew. Rows of a null key are one sequence; null entropies don't
    count in a mean, and a null token equals a null token."""
    spark = stream.sparkSession
    back = max(entropy_window, repeat_window) - 1
    s = stream.select(F.col(key).alias("_key"), F.col(pos).alias("_pos"), F.col(token).alias("_tok"),
                      F.col(entropy).cast("double").alias("_ent"))
    kinds = {f.name: f.dataType.simpleString() for f in s.schema}
    schema = f"_key {kinds['_key']}, at long, tail array<struct<_tok: {kinds['_tok']}, _ent: double>>"

    def step(batch: DataFrame, epoch: int, ckpt: str) -> None:
        numbered = with_ordinal(batch, ["_pos"], "_rn", partition_by=["_key"])
        ends = batch.groupBy("_key").agg(F.count(F.lit(1)).alias("_end"))
        tails = _before(spark, f"{ckpt}/tails", schema, epoch, 0 if horizon is None else max(0, epoch - horizon))
        tails = join_null_safe(tails, ends, ["_key"], "left_semi").groupBy("_key").agg(F.max_by("tail", "at").alias("tail"))
        old = tails.select("_key", F.size("tail").alias("_size"), F.posexplode("tail").alias("_i", "_row")).select(
            "_key", F.lit(None).cast(kinds["_pos"]).alias("_pos"), "_row.*", (F.col("_i") + 1 - F.col("_size")).cast("long").alias("_rn"))
        rows = numbered.select("_key", "_pos", "_tok", "_ent", "_rn").unionByName(old)
        rows = materialize(rows, "diagnostics-rows")
        # a row stands in its own block and, if the next one looks back to it, there as well
        home = F.floor((F.col("_rn") - 1) / block_rows)
        blocks = rows.withColumn("_home", home).withColumn(
            "_block", F.explode(F.sequence(F.col("_home"), F.floor((F.col("_rn") - 1 + back) / block_rows))))
        order = Window.partitionBy("_key", "_block").orderBy("_rn")
        newest = order.rowsBetween(1 - n_gram, Window.currentRow)
        gram = F.when(F.count(F.lit(1)).over(newest) == n_gram,
                      F.struct(*[F.lag("_tok", k).over(order).alias(f"t{k}") for k in range(n_gram)]))
        seen = F.collect_list("_gram").over(order.rowsBetween(n_gram - repeat_window, -1))
        told = (blocks.withColumn("_gram", gram)
                .withColumn("_mean", F.avg("_ent").over(order.rowsBetween(1 - entropy_window, Window.currentRow)))
                .withColumn("_hit", F.coalesce(F.array_contains(seen, F.col("_gram")), F.lit(False)))
                .where("_rn > 0 and _block = _home"))
        told.select(F.col("_key").alias(key), F.col("_pos").alias(pos), F.col("_mean").alias("avg_entropy"), F.col("_hit").alias("repeated")) \
            .write.mode("overwrite").parquet(f"{ckpt}/answers/epoch={epoch}")
        last = join_null_safe(rows, ends, ["_key"]).where(F.col("_rn") > F.col("_end") - back)
        last = last.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_rn", "_tok", "_ent"))).alias("tail"))
        last.select("_key", F.lit(epoch).cast("long").alias("at"), F.transform("tail", lambda x: F.struct(x["_tok"], x["_ent"])).alias("tail")) \
            .write.mode("overwrite").parquet(f"{ckpt}/tails/epoch={epoch}")

    return _each_epoch(s, name, checkpoint, step) + "/answers"
