"""Exact dedupe by SHA-1 of the cleaned text, first occurrence in order survives.

One shuffle on ``sha1``. ``min_by`` is a declarative aggregate, so each map task ships at most one
survivor per digest: a digest that holds a third of all rows costs one row per map task, not a
third of the data in one reducer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.materialize import materialize


def clean(docs: DataFrame, text_col: str = "text", normalise_first: bool = True) -> DataFrame:
    """P2 (optional) + P1 + P3: replace ``text`` by its cleaned form and add ``sha1``.

    Empty results keep ``sha1 = null`` so they can be counted and dropped.
    """
    cleaned = T.canonical_text(text_col) if normalise_first else T.clean_line(text_col)
    return (docs.withColumn(text_col, cleaned)
            .withColumn("sha1", F.when(F.col(text_col) != "", T.digest(text_col))))


def first_per_digest(cleaned: DataFrame, ord_col: str = "ord", key: str = "sha1") -> DataFrame:
    """The earliest row (by ``ord_col``) of every non-empty digest, all columns kept.

    No filter before the aggregate (Catalyst would push it below the cleaning projection and
    evaluate the normaliser twice): empty rows share the null key and get a null ordering, so
    their group yields null and is dropped after the aggregate."""
    cols = cleaned.columns
    order = F.when(F.col(key).isNotNull(), F.col(ord_col))
    return (cleaned.groupBy(key)
            .agg(F.min_by(F.struct(*cols), order).alias("_s"))
            .where(F.col("_s").isNotNull())
            .select("_s.*"))


def first_lines(docs: DataFrame, n: int, ord_col: str = "ord", text_col: str = "text") -> DataFrame:
    """The first ``n`` rows, by ``ord_col``, of :func:`first_per_digest`; only digests are shuffled."""
    key = F.when(F.col("sha1").isNotNull(), F.col(ord_col))
    kept = materialize(clean(docs, text_col).groupBy("sha1").agg(F.min(key).alias("_ord")).where(F.col("_ord").isNotNull())
                       .orderBy("_ord").limit(n), "first_lines")
    few = docs.join(F.broadcast(kept.select("_ord").distinct()), F.col(ord_col) == F.col("_ord"), "left_semi")
    few = clean(few, text_col).join(F.broadcast(kept.withColumnRenamed("sha1", "_sha1")),
                                    (F.col(ord_col) == F.col("_ord")) & (F.col("sha1") == F.col("_sha1")), "left_semi")
    return first_per_digest(few, ord_col)


def dedupe_stats(cleaned: DataFrame, text_col: str = "text", key: str = "sha1") -> DataFrame:
    """Input, empty, duplicates, kept, dedupe_ratio, bytes (kept text + newline) in one row."""
    per_key = cleaned.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.first(F.octet_length(text_col)).alias("b"))
    nonempty = F.sum(F.when(F.col(key).isNotNull(), F.col("n")))
    kept = F.count(F.when(F.col(key).isNotNull(), F.lit(1)))
    agg = per_key.agg(
        F.sum("n").alias("input_lines"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("n"))), F.lit(0)).alias("empty_dropped"),
        F.coalesce(nonempty - kept, F.lit(0)).alias("duplicates_dropped"),
        kept.alias("kept"),
        F.coalesce(F.sum(F.when(F.col(key).isNotNull(), F.col("b") + 1)), F.lit(0)).alias("bytes"),
        F.coalesce(nonempty, F.lit(0)).alias("_ne"))
    ratio = F.when(F.col("_ne") > 0, F.col("duplicates_dropped") / F.col("_ne")).otherwise(F.lit(0.0))
    return (agg.withColumn("dedupe_ratio", ratio.cast("double"))
            .select("input_lines", "empty_dropped", "duplicates_dropped", "kept", "dedupe_ratio",
                    "bytes"))


def new_since(candidates: DataFrame, published: DataFrame, key: str = "sha1") -> DataFrame:
    """Rows whose digest is not in an already-published table (incremental loads)."""
    return candidates.join(published.select(key), on=key, how="left_anti")


def incremental_dedupe(first: DataFrame, second: DataFrame, ord_col: str = "ord",
                       key: str = "sha1") -> DataFrame:
    """Dedupe ``second`` against itself and against the survivors of ``first``."""
    pub = first_per_digest(first, ord_col, key)
    return first_per_digest(new_since(second, pub.select(key), key), ord_col, key)
