"""training/evaluation windows over chunked shards.

* Sequential evaluation windows (start 0, ctx, 2ctx, ...; width ctx+1) are cut straight from the
  chunks: each chunk emits the pieces of the windows it overlaps, pieces are grouped by window.
  No join; shuffle volume is the shard size plus one token per window.
* Windows at arbitrary offsets (random samples) fetch their tokens with an equi-join on
  ``(shard, chunk_id)`` (J3): a few are broadcast to the chunks they cover, many are joined with the
  chunk they begin in; hot chunks are split by AQE's skew-join handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import filters
from tessera.operators.keys import join_null_safe
from tessera.operators.shards import _safe_slice

#: Windows that are broadcast to the chunks; more are joined by a shuffle.
FEW_WINDOWS = 10_000


def n_eval_windows(n: Column, context: int) -> Column:
    """W5 count: ``floor((n - ctx - 1) / ctx) + 1`` when ``n >= ctx + 1``, else 0."""
    return F.when(n >= context + 1, F.floor((n - context - 1) / context) + 1).otherwise(0).cast("bigint")


def eval_windows(chunks: DataFrame, meta: DataFrame, context: int) -> DataFrame:
    """``(shard, window_id, start, w)`` with ``w`` the ``ctx+1`` tokens from ``start``."""
    filters.check_context(context)
    ctx = context
    m = meta.select("shard", n_eval_windows(F.col("tokens"), ctx).alias("_nw"))
    c = join_null_safe(chunks, m, ["shard"])  # one row per shard on the right: broadcast by AQE
    s = F.col("start")
    e = F.col("start") + F.size("ids")
    lo = F.greatest(F.lit(0).cast("bigint"), F.ceil(s / ctx).cast("bigint") - 1)
    hi = F.least(F.floor((e - 1) / ctx).cast("bigint"), F.col("_nw") - 1)
    c = c.where(F.col("_nw") > 0).withColumn("window_id", F.explode(F.sequence(lo, F.greatest(lo, hi))))
    c = c.where(F.col("window_id") <= hi)
    ws = F.col("window_id") * ctx
    plo = F.greatest(s, ws)
    phi = F.least(e, ws + ctx + 1)
    pieces = c.select("shard", "window_id", plo.alias("_lo"),
                      _safe_slice("ids", plo - s + 1, phi - plo).alias("_p"))
    g = pieces.groupBy("shard", "window_id").agg(
        F.array_sort(F.collect_list(F.struct("_lo", "_p"))).alias("_ps"))
    return g.select("shard", "window_id", (F.col("window_id") * ctx).alias("start"),
                    F.flatten(F.transform("_ps", lambda x: x["_p"])).alias("w"))


def fetch(windows: DataFrame, chunks: DataFrame, width: int, chunk_size: int,
          key: str = "window_id") -> DataFrame:
    """Tokens ``[start, start+width)`` of every ``(key, shard, start)`` row.

    A few windows are broadcast: the chunks stay where they are, and no chunk is taken apart that no
    window needs. Else each chunk gets the first ids of those behind it, which are few, and is joined
    with the windows that begin in it, so a window is sliced from one row and never put together.
    """
    C = chunk_size
    on = ["shard", "chunk_id"]
    first = F.floor(F.col("start") / C).cast("bigint")
    chunks = chunks.select(*on, F.col("start").alias("_cs"), "ids")
    if len(windows.select("shard").limit(FEW_WINDOWS + 1).collect()) > FEW_WINDOWS:
        need = windows.select(key, "shard", "start", first.alias("chunk_id"))
        # no estimate can know how many windows a manifest was exploded into: they must not be broadcast
        j = join_null_safe(with_heads(chunks, width - 1, C), need.hint("merge"), on)
        at = F.col("start") - F.col("_cs") + 1
        return j.select(key, "shard", "start", _safe_slice("ids", at, F.lit(width)).alias("w"))
    last = F.floor((F.col("start") + width - 1) / C).cast("bigint")
    need = windows.select(key, "shard", "start", F.explode(F.sequence(first, last)).alias("chunk_id"))
    j = join_null_safe(chunks, F.broadcast(need), on)
    lo = F.greatest(F.col("start"), F.col("_cs"))
    hi = F.least(F.col("start") + width, F.col("_cs") + F.size("ids"))
    pieces = j.select(key, "shard", "start", lo.alias("_lo"),
                      _safe_slice("ids", lo - F.col("_cs") + 1, hi - lo).alias("_p"))
    g = pieces.groupBy(key, "shard", "start").agg(
        F.array_sort(F.collect_list(F.struct("_lo", "_p"))).alias("_ps"))
    return g.select(key, "shard", "start", F.flatten(F.transform("_ps", lambda x: x["_p"])).alias("w"))


def with_heads(chunks: DataFrame, n: int, chunk_size: int) -> DataFrame:
    """Chunks ``(shard, chunk_id, ids)`` with the ``n`` ids that follow each of them."""
    if n < 1:
        return chunks
    k = F.sequence(F.lit(1), F.lit(-(-n // chunk_size)))
    heads = chunks.select("shard", "chunk_id", "ids", F.explode(k).alias("_k")).select(
        "shard", (F.col("chunk_id") - F.col("_k")).alias("chunk_id"), "_k",
        _safe_slice("ids", F.lit(1), F.least(F.lit(chunk_size), n - (F.col("_k") - 1) * chunk_size)).alias("_h"))
    heads = heads.groupBy("shard", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("_k", "_h"))).alias("_hs")).select(
        "shard", "chunk_id", F.flatten(F.transform("_hs", lambda x: x["_h"])).alias("_h"))
    j = join_null_safe(chunks.hint("merge"), heads.hint("merge"), ["shard", "chunk_id"], "left")
    return j.withColumn("ids", F.concat("ids", F.coalesce("_h", F.array().cast("array<int>")))).drop("_h")


def shift(w: Column | str, context: int) -> tuple[Column, Column]:
    """``input_ids = w[:-1]``, ``labels = w[1:]`` as ``array<bigint>``."""
    col = F.col(w) if isinstance(w, str) else w
    x = F.slice(col, 1, context).cast("array<bigint>")
    y = F.slice(col, 2, context).cast("array<bigint>")
    return x, y


def with_shift(df: DataFrame, context: int, w: str = "w") -> DataFrame:
    x, y = shift(w, context)
    return df.withColumn("input_ids", x).withColumn("labels", y).drop(w)


def valid(context: int) -> Column:
    """Shapes are ``ctx`` and ``labels[:-1] == input_ids[1:]`` (arrays of longs hold no NaN)."""
    x, y = F.col("input_ids"), F.col("labels")
    ok = (F.size(x) == context) & (F.size(y) == context)
    if context > 1:
        ok = ok & (F.slice(y, 1, context - 1) == F.slice(x, 2, context - 1))
    return ok


def batches(windows: DataFrame, batch_size: int, max_batches: int | None = None,
            drop_last: bool = False, key: str = "window_id", by: list[str] | None = None) -> DataFrame:
    """``batch_id = window_id div B``; optional cap on batches (applied as a filter before
    any token fetch) and the loader's drop-last rule (only full batches)."""
    filters.check_positive("batch_size", batch_size)
    by = by or ["shard"]
    out = windows.withColumn("batch_id", F.floor(F.col(key) / batch_size).cast("bigint"))
    if max_batches is not None:
        out = out.where(F.col(key) < max_batches * batch_size)
    if drop_last:
        from pyspark.sql import Window
        out = out.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by, "batch_id"))) \
            .where(F.col("_n") == batch_size).drop("_n")
    return out
