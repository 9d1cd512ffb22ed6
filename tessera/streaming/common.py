"""Helpers shared by the streaming jobs: sources over the corpus tables, sinks and run control."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.session import shared_dir


def table_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """``readStream`` over a Parquet table folder/file with the schema taken from the data."""
    schema = spark.read.parquet(path).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        # a single-file table: stream its folder, restricted to that file name
        folder, name = path.rstrip("/").rsplit("/", 1)
        return r.option("pathGlobFilter", name).parquet(folder)
    return r.parquet(path)


def run_available(writer, name: str, spark: SparkSession, ckpt: str | None = None) -> tuple[StreamingQuery, str]:
    """Start with an ``availableNow`` trigger and a checkpoint (given, or new under the shared
    folder); wait. Re-running with the same checkpoint resumes where the last run stopped."""
    ckpt = ckpt or shared_dir(spark, f"ckpt-{name}")
    q = writer.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q, ckpt


def run_until(writer, ckpt: str, done: Callable[[], bool], trigger: dict | None = None, patience: float = 5.0) -> StreamingQuery:
    """Start with any trigger and stop the query when ``done`` says so, or wait until it ends.

    ``done`` must turn true at the end of a batch. The query is stopped between two triggers, when
    that batch is committed, or after ``patience`` seconds if batch follows on batch."""
    q = writer.option("checkpointLocation", ckpt).trigger(**(trigger or {"availableNow": True})).start()
    asked = None
    while not q.awaitTermination(0.1):
        if done():
            asked = asked or time.monotonic()
            if not q.status["isTriggerActive"] or time.monotonic() - asked > patience:
                q.stop()
    if not done() and q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return q


def to_parquet(df: DataFrame, name: str, mode: str = "append") -> str:
    """Run a streaming DataFrame to completion into a Parquet folder in the shared folder."""
    spark = df.sparkSession
    out = shared_dir(spark, name)
    w = df.writeStream.format("parquet").option("path", out).outputMode(mode)
    run_available(w, name, spark)
    return out


class ProgressListener:
    """Collects the observed metrics (``DataFrame.observe`` on a stream) of every trigger
    through a ``StreamingQueryListener``. One small row per trigger."""

    def __init__(self, spark: SparkSession, name: str):
        from pyspark.sql.streaming import StreamingQueryListener

        self.rows: list[dict] = []
        self._ended = threading.Event()
        outer = self

        class _L(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryProgress(self, event):
                m = event.progress.observedMetrics.get(name)
                if m is not None:
                    outer.rows.append({"batch": event.progress.batchId, **m.asDict()})

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                outer._ended.set()

        self._listener = _L()
        self._spark = spark
        spark.streams.addListener(self._listener)

    def wait(self, seconds: float = 60.0) -> list[dict]:
        """The rows once the query's end was reported: events come in order, after the query."""
        if not self._ended.wait(seconds):
            raise RuntimeError("the end of the stream was not reported")
        return self.rows

    def close(self) -> None:
        self._spark.streams.removeListener(self._listener)
