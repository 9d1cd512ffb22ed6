"""One-document-per-line text files.

Scan: ``spark.read.text`` decodes UTF-8 with U+FFFD for invalid bytes and splits on ``\\n``,
``\\r\\n`` and ``\\r``. Line order is (file order, byte offset inside the file); we record it as
``ord`` from ``_metadata.file_path``, ``_metadata.file_block_start`` and the row's position inside its
split, never from ``monotonically_increasing_id`` alone (Spark packs splits by size).
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import files as files_by_uri


def save_mode(force: bool = False, skip_existing: bool = False) -> str:
    """Refuse (default) / overwrite (force) / skip-if-exists."""
    if skip_existing:
        return "ignore"
    return "overwrite" if force else "errorifexists"


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """S3: ``(src_rank, file_path, ord, text)``; ``ord`` sorts in concatenation order and is unique.

    ``paths`` order is the concatenation order. ``ord`` is the struct ``(src_rank, file_path, block,
    line)``: the split's first byte in its file and the line's number inside the split. Files may
    be of any size and number. The line-number window is partitioned by split, so it runs in parallel.
    """
    frames = []
    for rank, p in enumerate(paths):
        df = (spark.read.text(p)
              .select(F.lit(rank).alias("src_rank"),
                      F.col("_metadata.file_path").alias("file_path"),
                      F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("_mid"),
                      F.col("value").alias("text")))
        frames.append(df)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    w = Window.partitionBy("src_rank", "file_path", "block").orderBy("_mid")
    key = F.struct("src_rank", "file_path", "block", F.row_number().over(w).alias("line"))
    return out.select("src_rank", "file_path", key.alias("ord"), "text")


def manifest_counts(lines: DataFrame, col: str = "line") -> DataFrame:
    """A1: lines written, empty lines skipped, bytes (UTF-8 + newline)."""
    c = F.col(col)
    return lines.agg(
        F.count(F.when(c != "", F.lit(1))).cast("bigint").alias("lines"),
        F.count(F.when(c == "", F.lit(1))).cast("bigint").alias("empty_skipped"),
        F.coalesce(F.sum(F.when(c != "", F.octet_length(c) + 1)), F.lit(0)).cast("bigint").alias("bytes"))


def write_docs(docs: DataFrame, out_dir: str, text_col: str = "text", ord_col: str = "ord",
               force: bool = False) -> DataFrame:
    """Normalised document per line, empty ones skipped, refuses to overwrite unless forced.

    Output is range-partitioned on ``ord`` so part files concatenate in document order.
    Returns the manifest counters (computed in the same job via ``observe``).
    """
    from pyspark.sql import Observation
    obs = Observation("text_sink")
    lines = docs.select(F.col(ord_col), T.normalize_doc(text_col).alias("line"))
    # observe above the range exchange: the exchange's sampling job must not count rows twice
    ranged = lines.repartitionByRange(ord_col)
    observed = ranged.observe(obs, F.count(F.when(F.col("line") != "", F.lit(1))).alias("lines"),
                              F.count(F.when(F.col("line") == "", F.lit(1))).alias("empty_skipped"),
                              F.coalesce(F.sum(F.when(F.col("line") != "", F.octet_length("line") + 1)),
                                         F.lit(0)).alias("bytes"))
    (observed.where(F.col("line") != "").sortWithinPartitions(ord_col)
     .select("line").write.mode(save_mode(force)).text(out_dir))
    spark = docs.sparkSession
    m = obs.get
    return spark.createDataFrame([(out_dir, int(m["lines"]), int(m["empty_skipped"]), int(m["bytes"]))],
                                 "path string, lines bigint, empty_skipped bigint, bytes bigint")


def file_checksums(spark: SparkSession, path_glob: str) -> DataFrame:
    """SHA-256 and byte size per file. Files are listed by Spark (names and lengths only) and
    read in blocks of 1 MB, one task a file at most, so they may be of any size."""
    files = spark.read.format("binaryFile").load(path_glob).select("path", F.col("length").alias("bytes"))
    return files.repartition("path").mapInPandas(_digests, "path string, bytes long, sha256 string")


def _digests(frames):
    for frame in frames:
        for path, size in zip(frame["path"], frame["bytes"]):
            digest = hashlib.sha256()
            for block in files_by_uri.blocks(path):
                digest.update(block)
            yield pd.DataFrame([(path, size, digest.hexdigest())], columns=["path", "bytes", "sha256"])
