"""Reproducible window sampling and token-weighted shard mixtures.

Random numbers are md5-derived integers keyed by ``(seed, shard, index)``: every draw is a pure
function of its row, so results do not depend on partitioning, retries or worker count (M3), and
DuckDB can recompute them. They are not bit-equal to numpy's PCG64 stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import filters
from tessera.operators.keys import join_null_safe

# Fixed values (must equal the reference's behaviour)
STRIDE = 9973          # index fold of the reference sampler
SUBSEED_STEP = 1009    # per-shard sub-seed step of the reference mixture
MIX_BUCKETS = 1024     # resolution of the bucketed range join
MAX_BROADCAST_SHARDS = 100_000


def md5_int(*parts: Column) -> Column:
    """A 60-bit integer from the md5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """Uniform double in [0, 1) from :func:`md5_int`."""
    return md5_int(*parts).cast("double") / F.lit(float(2 ** 60))


def mix_weights(meta: DataFrame, shard_list: list[str]) -> DataFrame:
    """A9 (+U2): per distinct shard of the list, ``p = copies*tokens / sum``, cumulative bounds.

    The list is small (configured shards); repeated names add their weight (bag union).
    """
    spark = meta.sparkSession
    if not shard_list:
        raise ValueError("a mixture names at least one shard")
    copies: dict[str, int] = {}
    first: dict[str, int] = {}
    for i, s in enumerate(shard_list):
        copies[s] = copies.get(s, 0) + 1
        first.setdefault(s, i)
    lst = spark.createDataFrame([(first[s], s, c) for s, c in copies.items()],
                                "shard_rank int, shard string, copies int")
    t = join_null_safe(lst, meta.select("shard", "tokens"), ["shard"], "left")
    if missing := [str(r["shard"]) for r in t.where("tokens is null").orderBy("shard").collect()]:
        raise ValueError(f"the manifest has no shard {', '.join(missing)}")
    t = t.withColumn("weight", (F.col("copies") * F.col("tokens")).cast("bigint"))
    w_all = Window.partitionBy(F.lit(1))                 # a handful of rows
    w_cum = Window.partitionBy(F.lit(1)).orderBy("shard_rank").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_tot", F.sum("weight").over(w_all)).withColumn("_cum", F.sum("weight").over(w_cum))
    t = t.withColumn("_last", F.max("shard_rank").over(w_all))
    return t.select(
        "shard_rank", "shard", "copies", "tokens", "weight",
        (F.col("weight") / F.col("_tot")).alias("p"),
        ((F.col("_cum") - F.col("weight")) / F.col("_tot")).alias("cum_lo"),
        F.when(F.col("shard_rank") == F.col("_last"), F.lit(1.0))
        .otherwise(F.col("_cum") / F.col("_tot")).alias("cum_hi"))


def pick_shard(draws: DataFrame, weights: DataFrame, u: str = "u") -> DataFrame:
    """The shard with ``cum_lo <= u < cum_hi`` (``searchsorted(side='right')``).

    Bucketed range join: each shard interval is listed under the ``MIX_BUCKETS`` buckets of [0,1)
    it overlaps (at most shards + buckets rows), draws join on their bucket, then the exact
    interval test. The interval table is broadcast only below ``MAX_BROADCAST_SHARDS`` rows.
    """
    K = MIX_BUCKETS
    iv = weights.select("shard", "shard_rank", "tokens", "cum_lo", "cum_hi").where(F.col("cum_hi") > F.col("cum_lo"))
    b_lo = F.floor(F.col("cum_lo") * K).cast("int")
    b_hi = F.least(F.lit(K - 1), F.floor(F.col("cum_hi") * K).cast("int"))
    iv = iv.withColumn("_b", F.explode(F.sequence(b_lo, F.greatest(b_lo, b_hi))))
    n = iv.count()
    side = F.broadcast(iv) if n <= MAX_BROADCAST_SHARDS else iv
    d = draws.withColumn("_b", F.least(F.lit(K - 1), F.floor(F.col(u) * K).cast("int")))
    j = d.join(side, "_b").where((F.col(u) >= F.col("cum_lo")) & (F.col(u) < F.col("cum_hi")))
    return j.drop("_b", "cum_lo", "cum_hi")


def sample_starts(n_tokens: Column, context: int, seed: Column, shard: Column, i: str = "i") -> Column:
    """M1: ``(r + i*9973) mod (max_start+1)`` with ``r`` uniform in ``[0, max_start]``."""
    m = n_tokens - (context + 1) + 1
    r = F.pmod(md5_int(seed.cast("string"), shard, F.col(i).cast("string")), m)
    return F.pmod(r + F.col(i) * STRIDE, m)


def index_rows(spark: SparkSession, n: int, partitions: int | None = None) -> DataFrame:
    """Sample indices ``0..n-1`` spread over partitions (``n`` comes from the data: epoch length)."""
    filters.check_positive("num_samples", n)
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "8"))
    return spark.range(0, n, 1, max(1, min(parts, n))).withColumnRenamed("id", "i")


def single_shard_samples(spark: SparkSession, meta_row: dict, context: int, seed: int,
                         num_samples: int | None = None) -> DataFrame:
    """M1 for one shard: ``(i, shard, start)``; default count is the epoch length."""
    filters.check_context(context)
    n = int(meta_row["tokens"])
    if n < context + 1:
        raise ValueError(f"too few tokens for one window: {n}, window of {context + 1}")
    k = num_samples if num_samples is not None else max(1, n // (context + 1))
    idx = index_rows(spark, k)
    start = sample_starts(F.lit(n), context, F.lit(seed), F.lit(meta_row["shard"]))
    return idx.select("i", F.lit(meta_row["shard"]).alias("shard"), start.alias("start"))


INDEX_BLOCK = 1 << 16  # sample indices that one row stands for before they are spread


def _per_shard(meta: DataFrame, context: int, count: Column) -> DataFrame:
    """``(shard, tokens, i)`` with ``i`` from 0 to ``count - 1`` for every row of the manifest. A row
    becomes blocks of indices first, so a shard of any length is spread over all tasks."""
    filters.check_context(context)
    short = meta.where(F.col("tokens") < context + 1).select("shard", "tokens").limit(1).collect()
    if short:
        raise ValueError(f"too few tokens for one window: {short[0]['tokens']} in {short[0]['shard']}, window of {context + 1}")
    rows = meta.select("shard", "tokens", count.cast("bigint").alias("_k")).where("_k > 0")
    blocks = rows.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_k") - 1) / INDEX_BLOCK))))
    first = F.col("_b") * INDEX_BLOCK
    last = F.least(F.col("_k"), first + INDEX_BLOCK) - 1
    return blocks.repartition("shard", "_b").select("shard", "tokens", F.explode(F.sequence(first, last)).alias("i"))


def _name(shard: Column) -> Column:
    return F.coalesce(shard, F.lit(""))


def shard_samples(meta: DataFrame, context: int, seed: int, num_samples: int | None = None) -> DataFrame:
    """M1 for every shard of a manifest: ``(shard, i, start)``; as many as the epoch length (W8) or
    ``num_samples`` of each."""
    n = F.greatest(F.lit(1), F.floor(F.col("tokens") / (context + 1))) if num_samples is None else F.lit(num_samples)
    start = sample_starts(F.col("tokens"), context, F.lit(seed), _name(F.col("shard")))
    return _per_shard(meta, context, n).select("shard", "i", start.alias("start"))


def loader_rows(meta: DataFrame, context: int, batch_size: int, seed: int, epochs: int = 1) -> DataFrame:
    """M4: the loader over every shard of a manifest for ``epochs`` passes: sample ``i`` of a shard
    belongs to ``epoch = i div epoch_len``; batches of ``batch_size`` inside an epoch, last partial
    batch dropped. Draws are keyed by the run-wide index, so epochs differ. ``(shard, epoch,
    batch_id, i, start)``; a shard whose epoch is shorter than one batch is refused."""
    filters.check_positive("batch_size", batch_size)
    filters.check_positive("epochs", epochs)
    per = F.greatest(F.lit(1), F.floor(F.col("tokens") / (context + 1))).cast("bigint")
    full = F.floor(per / batch_size) * batch_size
    if meta.where(full == 0).limit(1).count():
        raise ValueError("epoch shorter than one batch")
    epoch, at = F.floor(F.col("i") / per).cast("bigint"), F.pmod(F.col("i"), per)
    start = sample_starts(F.col("tokens"), context, F.lit(seed), _name(F.col("shard")))
    return _per_shard(meta, context, per * epochs).where(at < full).select(
        "shard", epoch.alias("epoch"), (epoch * (full / batch_size).cast("bigint") + F.floor(at / batch_size)).cast("bigint").alias("batch_id"),
        "i", start.alias("start"))


def mixture_samples(spark: SparkSession, weights: DataFrame, context: int, seed: int,
                    num_samples: int) -> DataFrame:
    """M2/M3: shard by token-weighted draw (J2), then an M1 start inside that shard with the
    shard's sub-seed ``seed + rank*1009``. ``(i, shard, start)``."""
    short = weights.where(F.col("tokens") < context + 1).select("shard").limit(1).collect()
    if short:
        raise ValueError(f"shard {short[0][0]} has fewer than {context + 1} tokens")
    idx = index_rows(spark, num_samples)
    d = idx.withColumn("u", uniform(F.lit("mix"), F.lit(str(seed)), F.col("i").cast("string")))
    j = pick_shard(d, weights)
    sub = (F.lit(seed) + F.col("shard_rank") * SUBSEED_STEP)
    start = sample_starts(F.col("tokens"), context, sub, _name(F.col("shard")))
    return j.select("i", "shard", start.alias("start"))
