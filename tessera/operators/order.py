"""W1 and running sums over a global order without a single-partition window.

Spark evaluates ``Window.orderBy(...)`` with no ``partitionBy`` in one task. Instead:

1. cut the order column into ``n_buckets`` quantile buckets (``approxQuantile`` + ``Bucketizer``;
   a monotone function of the order, so bucket order = global order);
2. running sum inside each bucket (``Window.partitionBy(bucket)``: parallel, balanced even when the
   order values are clustered, because cuts come from quantiles);
3. per-bucket totals (a table of at most groups x buckets rows) turned into offsets with a window
   over that small table;
   Groups may have null fields, and rows without an order value form a bucket of their own;
4. offsets joined back on the bucket key. The big side is already hash-partitioned and sorted by
   that key from step 2, so the join adds no shuffle of the big side.
"""

from __future__ import annotations

import os

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BKT = "_bkt"
# the columns of a group as one struct: a struct is never null, so groups with null fields join too
_GROUP = "_grp"
_NO_ORDER = -1  # bucket of rows without an order value: before all others, as nulls sort first


def default_buckets(df: DataFrame) -> int:
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(1, 4 * parts)


def _text_as_double(df: DataFrame, col: str) -> Column:
    """Monotone view of a text column: the six bytes after the prefix that all values share."""
    code = F.hex(F.encode(F.col(col), "UTF-8"))
    low, high = df.agg(F.min(code), F.max(code)).first()
    shared = len(os.path.commonprefix([low or "", high or ""]))
    return F.conv(F.rpad(F.substring(code, shared + 1, 12), 12, "0"), 16, 10).cast("double")


def _as_double(df: DataFrame, col: str) -> Column:
    """Monotone numeric view of an order column (timestamps as microseconds)."""
    dt = df.schema[col].dataType.typeName()
    if dt.startswith("timestamp") or dt == "date":
        from tessera.functions.timecols import epoch_micros
        return epoch_micros(df, col).cast("double")
    if dt in ("string", "char", "varchar"):
        return _text_as_double(df, col)
    return F.col(col).cast("double")


def with_bucket(df: DataFrame, order_col: str, n_buckets: int | None = None,
                bucket_key: Column | None = None) -> DataFrame:
    """Add ``_bkt``: a quantile bucket of ``order_col`` (or of ``bucket_key``, any double that is
    monotone non-decreasing in the full order), so bucket order = global order."""
    n = n_buckets or default_buckets(df)
    if n <= 1:
        return df.withColumn(_BKT, F.lit(0))
    probs = [i / n for i in range(1, n)]
    tmp = "_bkt_in"
    src = df.withColumn(tmp, bucket_key if bucket_key is not None else _as_double(df, order_col))
    qs = src.approxQuantile(tmp, probs, 1.0 / (4 * n))
    cuts = sorted(set(q for q in qs if q is not None))
    splits = [float("-inf")] + cuts + [float("inf")]
    if len(splits) < 3:
        return df.withColumn(_BKT, F.lit(0))
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol="_bkt_d", handleInvalid="keep")
    return b.transform(src).withColumn(_BKT, F.coalesce(F.col("_bkt_d").cast("int"), F.lit(_NO_ORDER))).drop(tmp, "_bkt_d")


def with_running_sums(df: DataFrame, order_cols: list[str], values: dict[str, Column],
                      partition_by: list[str] | None = None, exclusive: bool = False,
                      n_buckets: int | None = None, dtype: str = "bigint",
                      bucket_key: Column | None = None) -> DataFrame:
    """Add one running-sum column per entry of ``values`` (name -> numeric Column).

    ``order_cols`` must be a unique order within each ``partition_by`` group; the first one is
    bucketed unless ``bucket_key`` (see :func:`composite_key`) covers several order columns.
    ``exclusive`` gives sums of the rows strictly before each row.
    """
    part = [_GROUP] if partition_by else []
    keys = part + [_BKT]
    vals = {f"_v_{k}": (F.col(v) if isinstance(v, str) else v).cast(dtype) for k, v in values.items()}
    b = with_bucket(df, order_cols[0], n_buckets, bucket_key).withColumns(vals)
    if part:
        b = b.withColumn(_GROUP, F.struct(*partition_by))
    w_in = (Window.partitionBy(*keys).orderBy(*order_cols)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = b.withColumns({f"_r_{k}": F.sum(f"_v_{k}").over(w_in) for k in values})
    # totals come from the window's output: same exchange (reused), so the input is computed once
    totals = inner.groupBy(*keys).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    w_off = (Window.partitionBy(*part).orderBy(_BKT)
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*keys, *[
        F.coalesce(F.sum(f"_t_{k}").over(w_off), F.lit(0)).alias(f"_o_{k}") for k in values])
    out = inner.join(offsets, on=keys, how="inner")
    cols = {}
    for k in values:
        run = F.col(f"_o_{k}") + F.col(f"_r_{k}")
        cols[k] = (run - F.col(f"_v_{k}")) if exclusive else run
    out = out.withColumns(cols)
    drop = keys + [f"_{p}_{k}" for k in values for p in ("v", "r", "o")]
    return out.drop(*drop)


def composite_key(major: str, minor: str, minor_bits: int = 32) -> Column:
    """Double bucket key for the order ``(major, minor)`` with ``0 <= minor < 2**minor_bits``:
    ``major * 2**bits + minor`` in double arithmetic. Rounding is monotone, so the key never
    decreases along the order (ties only merge neighbours into one bucket), and a single ``major``
    value with many ``minor`` rows (one huge document) still spreads over many buckets."""
    return F.col(major).cast("double") * F.lit(float(2 ** minor_bits)) + F.col(minor).cast("double")


def with_ordinal(df: DataFrame, order_cols: list[str], name: str = "ord",
                 partition_by: list[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """1-based dense row number in the given order (per ``partition_by`` group)."""
    return with_running_sums(df, order_cols, {name: F.lit(1)}, partition_by=partition_by,
                             n_buckets=n_buckets)


def with_running_extreme(df: DataFrame, order_cols: list[str], name: str, value: Column,
                         how: str = "min", partition_by: list[str] | None = None,
                         n_buckets: int | None = None) -> DataFrame:
    """Running min/max (inclusive) in order, with the same bucketed plan as the sums."""
    part = [_GROUP] if partition_by else []
    keys = part + [_BKT]
    fn = F.min if how == "min" else F.max
    pick = F.least if how == "min" else F.greatest
    b = with_bucket(df, order_cols[0], n_buckets).withColumn("_v", value)
    if part:
        b = b.withColumn(_GROUP, F.struct(*partition_by))
    w_in = (Window.partitionBy(*keys).orderBy(*order_cols)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = b.withColumn("_r", fn("_v").over(w_in))
    totals = inner.groupBy(*keys).agg(fn("_v").alias("_t"))
    w_off = Window.partitionBy(*part).orderBy(_BKT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, fn("_t").over(w_off).alias("_o"))
    out = inner.join(offsets, on=keys, how="inner")
    run = F.when(F.col("_o").isNull(), F.col("_r")).otherwise(pick(F.col("_o"), F.col("_r")))
    return out.withColumn(name, run).drop(*keys, "_v", "_r", "_o")


def with_lag(df: DataFrame, order_cols: list[str], cols: dict[str, str], offset: int = 1,
             partition_by: list[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """``lag(col, offset)`` per group without a per-group window: number the rows (bucketed),
    then an equi-join on ``(group, row number - offset)`` — keys are unique, so no hot key."""
    part = [_GROUP] if partition_by else []
    numbered = with_ordinal(df, order_cols, "_rn", partition_by=partition_by, n_buckets=n_buckets)
    if part:
        numbered = numbered.withColumn(_GROUP, F.struct(*partition_by))
    prev = numbered.select(*part, (F.col("_rn") + offset).alias("_rn"),
                           *[F.col(src).alias(dst) for dst, src in cols.items()])
    return numbered.join(prev, part + ["_rn"], "left").drop(*part, "_rn")
