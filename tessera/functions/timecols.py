"""Time columns as numbers, independent of the session time zone.

``timestamp_ntz`` values are wall-clock values; casting them to ``timestamp`` goes through the
session zone (DST gaps/overlaps would shift or even reorder them). Differences from a fixed NTZ
epoch are zone-free, so NTZ columns go through ``timestamp_diff`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970-01-01 (UTC for ``timestamp``, wall clock for ``timestamp_ntz``)."""
    t = df.schema[col].dataType.typeName()
    if t == "timestamp_ntz":
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(col))
    if t in ("timestamp", "date"):
        return F.unix_micros(F.col(col).cast("timestamp"))
    return F.col(col).cast("bigint")


def epoch_seconds(df: DataFrame, col: str) -> Column:
    return epoch_micros(df, col) / F.lit(1e6)
