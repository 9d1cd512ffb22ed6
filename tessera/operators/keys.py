"""Joins on keys that may be null: a null key meets a null key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.materialize import materialize

#: Rows of a table, such as one row per shard, that is broadcast.
MAX_SMALL = 200_000


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on the columns ``on``, nulls equal; the keys come from ``left``."""
    names = {c: f"_{c}_right" for c in on}
    other = right.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [left[c].eqNullSafe(other[n]) for c, n in names.items()])
    joined = left.join(other, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*names.values())


def small(table: DataFrame, name: str) -> DataFrame:
    """A table of few rows, such as one per shard, computed once. It is broadcast if it is as small as
    expected: Spark estimates an aggregate by its input's size and would shuffle the other side by shard."""
    stored = materialize(table, name)
    return F.broadcast(stored) if stored.count() <= MAX_SMALL else stored
