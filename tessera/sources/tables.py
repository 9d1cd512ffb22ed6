"""Scans of the corpus tables.

Every scan names its columns so Parquet reads only those (``ReadSchema`` in the plan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def corpus_scan(df: DataFrame, text_field: str = "text", *keep: str) -> DataFrame:
    """Project one text field, drop nulls, coerce to string."""
    return (df.select(*keep, F.col(text_field).cast("string").alias("text"))
            .where(F.col("text").isNotNull()))


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Documents with ``ord = doc_id`` (the stream order)."""
    want = list(cols) if cols else ["doc_id", "source", "lang", "text"]
    df = table(spark, sf_dir, "documents", *[c for c in want if c != "ord"])
    if "ord" in want:
        df = df.withColumn("ord", F.col("doc_id"))
    return df


def identified(df: DataFrame, id_cols: list[str], ordinal_col: str, text_field: str = "text"
               ) -> DataFrame:
    """``doc_id = string(coalesce(id, dump, row index))``; null text -> ''. Works on batch and
    streaming tables alike; ``ordinal_col`` is the row index that the source recorded."""
    ids = [F.col(c).cast("string") for c in id_cols] + [F.col(ordinal_col).cast("string")]
    return df.select(F.coalesce(*ids).alias("doc_id"),
                     F.coalesce(F.col(text_field).cast("string"), F.lit("")).alias("text"))
