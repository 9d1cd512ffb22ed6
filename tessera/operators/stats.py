"""Corpus summary per source with a grand total (``rollup``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def corpus_summary(rows: DataFrame, key: str = "source") -> DataFrame:
    """``rows(key, bytes, tokens)`` -> docs, bytes, tokens and token share per key plus a total row.

    The share divides by the grand total, read from the rollup's total row through a window over
    the rollup output (a handful of rows), so the table is scanned once.
    """
    r = rows.rollup(key).agg(F.count(F.lit(1)).cast("bigint").alias("docs"),
                             F.sum("bytes").cast("bigint").alias("bytes"),
                             F.sum("tokens").cast("bigint").alias("tokens"),
                             F.grouping(key).alias("_g"))
    total = F.max(F.when(F.col("_g") == 1, F.col("tokens"))).over(Window.partitionBy(F.lit(1)))
    return r.withColumn("token_share", F.round(F.col("tokens") / total, 6)).drop("_g")
