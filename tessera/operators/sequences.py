"""Repetition and rolling statistics over token / value sequences.

W13 implements the documented intent of the reference accumulator: the n-gram ending at the
current token is a repeat when the same n-gram started earlier within the last ``repeat_window``
tokens (the reference's own check is always true once ``n`` tokens exist).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.keys import join_null_safe
from tessera.operators.order import with_ordinal, with_running_sums

def _repeats(tokens, n: int, repeat_window: int):
    """For each complete n-gram, whether it is a repeat: n-grams are numbered, then each one's places
    are compared with the place before."""
    if tokens is None:
        return None
    codes = pd.factorize(np.asarray(tokens, dtype=object))[0].astype(np.int64) + 1
    m = len(codes) - n + 1
    if m < 1:
        return np.zeros(0, bool)
    grams = codes[:m]
    for k in range(1, n):
        grams = pd.factorize(grams * (len(codes) + 1) + codes[k:k + m])[0].astype(np.int64)
    order = np.argsort(grams, kind="stable")
    out = np.zeros(m, bool)
    out[order[1:]] = (grams[order[1:]] == grams[order[:-1]]) & (np.diff(order) <= repeat_window - n)
    return out


def ngram_repeats(seqs: DataFrame, key: str, tokens: str, n: int = 3, repeat_window: int = 64) -> DataFrame:
    """Per sequence position: ``(key, pos, repeated)`` for every complete n-gram.

    The earlier occurrence must start at or after ``pos + n - repeat_window`` (inside the last
    ``repeat_window`` tokens ending at the current token). A sequence is one row, so its n-grams are
    compared where the row is, without a shuffle; a null token equals a null token.
    """
    @F.pandas_udf("array<boolean>")
    def repeated(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: _repeats(t, n, repeat_window))

    return seqs.select(key, F.posexplode(repeated(F.col(tokens).cast("array<string>"))).alias("pos", "repeated"))


def rolling_mean(df: DataFrame, key: str, order_cols: list[str], value: str, width: int = 20,
                 out: str = "rolling") -> DataFrame:
    """Mean of the last ``width`` values per key (current included), in order.

    Exact and skew-safe: row number and running sum per key (bucketed, decimal so the difference of
    two prefix sums is exact), then the running sum ``width`` rows back through an equi-join on
    ``(key, row number)`` — a unique key, so a key with a third of all rows is still spread out.
    """
    num = with_ordinal(df, order_cols, "_rn", partition_by=[key])
    num = num.withColumn("_vd", F.col(value).cast("decimal(38,12)"))
    ps = with_running_sums(num, ["_rn"], {"_S": F.col("_vd")}, partition_by=[key], dtype="decimal(38,12)")
    back = ps.select(key, (F.col("_rn") + width).alias("_rn"), F.col("_S").alias("_Sb"))
    j = join_null_safe(ps, back, [key, "_rn"], "left")
    total = F.col("_S") - F.coalesce(F.col("_Sb"), F.lit(0).cast("decimal(38,12)"))
    cnt = F.least(F.col("_rn"), F.lit(width))
    return j.withColumn(out, (total / cnt).cast("double")).drop("_rn", "_vd", "_S", "_Sb")

