"""Latest state of growing run logs — text source -> line parse (P21) -> the last step and the last
loss of each run in file order, published after every trigger as a small table (one row per run).

The status after epoch *e* is that after *e - 1* joined with the lines of *e*, in a folder of its own,
so an epoch that runs again writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.runs import latest_status, parse_log_line
from tessera.session import shared_dir
from tessera.streaming.common import run_available


def status_stream(spark: SparkSession, log_dir: str, run_from_path: bool = True) -> DataFrame:
    """Parsed log lines ``(run, step, loss, path, block)`` from every text file under ``log_dir``.

    The run name is the file's parent folder (``logs/<run>/run.log``) unless told otherwise."""
    lines = spark.readStream.text(log_dir).select(F.col("value").alias("line"),
                                                  F.col("_metadata.file_path").alias("path"),
                                                  F.col("_metadata.file_block_start").alias("block"))
    step, loss = parse_log_line(F.col("line"))
    run = F.element_at(F.split("path", "/"), -2) if run_from_path else F.lit("run")
    return lines.select(run.alias("run"), step.alias("step"), loss.alias("loss"), "path", "block")


def heartbeat(spark: SparkSession, log_dir: str, name: str = "status") -> str:
    """Run the status query over what is in ``log_dir`` now; returns the folder of the last status
    ``(run, last_step, last_loss)``. A log's files follow each other by epoch, then by name."""
    out = shared_dir(spark, name)
    published = [-1]

    def publish(bdf: DataFrame, epoch: int) -> None:
        # rows of one split keep the order of their lines in the micro-batch
        place = F.struct(F.lit(epoch).alias("epoch"), F.col("path"), F.col("block"),
                         F.monotonically_increasing_id().alias("line"))
        rows = bdf.withColumn("at", place).select("run", "step", "loss", "at")
        if epoch > 0:
            before = spark.read.parquet(f"{out}/epoch-{epoch - 1}").select(
                "run", F.col("last_step").alias("step"), F.col("last_loss").alias("loss"),
                F.struct(F.lit(epoch - 1).alias("epoch"), F.lit("").alias("path"), F.lit(0).cast("bigint").alias("block"),
                         F.lit(0).cast("bigint").alias("line")).alias("at"))
            rows = before.unionByName(rows)
        latest_status(rows, order="at").write.mode("overwrite").parquet(f"{out}/epoch-{epoch}")
        published[0] = epoch

    run_available(status_stream(spark, log_dir).writeStream.foreachBatch(publish), name, spark)
    return f"{out}/epoch-{published[0]}"
