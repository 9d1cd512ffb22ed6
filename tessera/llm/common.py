"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.materialize import materialize
from tessera.session import ensure_checkpoint_dir

#: ASCII white space, the set [\x20\x09-\x0D].
SPACE = "\t\n\x0b\x0c\r "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of one Arrow batch: texts may be long, so a batch must hold few of them.
ARROW_ROWS = 256


def prepare(spark: SparkSession) -> None:
    """Shared folder, code on the executors, small Arrow batches."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, _UPPER, _LOWER)


def ascii_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text (null: 0)."""
    trimmed = ascii_trim(F.coalesce(text, F.lit("")))
    return F.when(trimmed == "", F.lit(0)).otherwise(
        F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))).cast("long")


def free_name(name: str, taken: list[str]) -> str:
    """A column name that none of ``taken`` has, whatever the case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the columns alone, so reruns agree."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


__all__ = ["ARROW_ROWS", "SPACE", "ascii_lower", "ascii_trim", "free_name", "materialize", "prepare", "read",
           "uniform", "word_count"]
