"""9. Sharding by longest processing time.

Documents with equal texts form a group that stays together. Groups are sorted by size and each
goes to the least loaded shard, held in a heap. No list of all groups is held anywhere: the sorted
groups are cut into blocks of equal counts, the largest first. Each block but the last runs the rule
in a task, one row at a time, and puts its groups into one bundle per shard. The bundles of all
blocks (``MAX_BLOCKS`` times the shards at most) are scheduled by the same rule. The groups of the
last block, the smallest of all, then go one by one to the least loaded shard, so they level what
the bundles left apart. With one block this is the plain rule over all groups.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, prepare
from tessera.operators.order import composite_key, with_running_sums

#: Groups of a block, unless that makes more than ``MAX_BLOCKS`` blocks (the driver's schedule sees a
#: bundle per block and shard).
BLOCK_GROUPS, MAX_BLOCKS = 1 << 16, 2048
#: Documents that one slot window sorts, on average.
SLOT_ROWS = 20_000


def schedule(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Longest processing time first: (size, name) to the least loaded shard; ties by name and
    by the lower shard."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        load, s = heapq.heappop(heap)
        out[name] = s
        heapq.heappush(heap, (load + size, s))
    return out


def _least_loaded(start: list[int]):
    """Rows (_block, _bytes, _group) sorted by block and size: each group to the least loaded of the
    block's bundles, which start at the given loads."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, heap = None, []
        for frame in frames:
            at = []
            for b, size in zip(frame["_block"], frame["_bytes"]):
                if b != block:
                    block, heap = b, [(load, s) for s, load in enumerate(start)]
                    heapq.heapify(heap)
                load, s = heap[0]
                heapq.heapreplace(heap, (load + size, s))
                at.append(s)
            yield pd.DataFrame({"_group": frame["_group"], "_block": frame["_block"], "_bytes": frame["_bytes"],
                                "_bundle": at})
    return run


def _place(groups: DataFrame, shards: int, block_groups: int) -> DataFrame:
    """(_group, _shard) for (_group, _bytes), by longest processing time."""
    spark = groups.sparkSession
    sized = groups.select("_group", "_bytes", (-F.col("_bytes")).alias("_less"),
                          F.pmod(F.xxhash64("_group"), F.lit(1 << 20)).alias("_mix"))
    ranked = with_running_sums(sized, ["_less", "_mix", "_group"], {"_rank": F.lit(1)},
                               bucket_key=composite_key("_less", "_mix", 20))
    n = groups.count()
    blocks = max(1, min(MAX_BLOCKS, -(-n // block_groups)))
    last = blocks - 1
    ranked = materialize(ranked.select("_group", "_bytes", "_rank", F.floor(
        (F.col("_rank") - 1) * blocks / F.lit(max(n, 1))).cast("int").alias("_block")), "shard-ranked")
    schema = "_group binary, _block int, _bytes long, _bundle int"

    def run(part: DataFrame, start: list[int], tasks: int) -> DataFrame:
        return (part.repartition(tasks, "_block").sortWithinPartitions("_block", "_rank")
                .mapInPandas(_least_loaded(start), schema))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = materialize(run(ranked.where(F.col("_block") < last), [0] * shards, max(1, min(parts, last))), "shard-bundles")
    bundles = first.groupBy("_block", "_bundle").agg(F.sum("_bytes").alias("_bytes")).collect()
    plan = schedule([(r["_bytes"], f"{r['_block']:05d}:{r['_bundle']:05d}") for r in bundles], shards)
    loads = [0] * shards
    for r in bundles:
        loads[plan[f"{r['_block']:05d}:{r['_bundle']:05d}"]] += r["_bytes"]
    placed = spark.createDataFrame([(int(k[:5]), int(k[6:]), s) for k, s in plan.items()],
                                   "_block int, _bundle int, _shard int")
    rest = run(ranked.where(F.col("_block") == last), loads, 1).select("_group", F.col("_bundle").alias("_shard"))
    return materialize(first.join(F.broadcast(placed), ["_block", "_bundle"]).select("_group", "_shard")
                       .unionByName(rest), "shard-placed")


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text",
          block_groups: int = BLOCK_GROUPS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """(id, size, text_crc32, shard, slot): UTF-8 bytes plus 1, and a gapless place in the shard.

    Null and empty texts have size 1 and form one group. Repeated rows are rows of their own,
    with slots of their own (which of two equal rows gets which is not told apart). Null ids come
    first within their part of the shard. An empty table gives an empty table. A group larger
    than a shard's share stays whole, so its shard is then the largest. Other columns are not
    read, so their names can't clash.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = materialize(docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("_size"),
        F.crc32(text).alias("_crc"), F.unhex(F.sha2(text, 256)).alias("_group"),
        F.monotonically_increasing_id().alias("_at")), "shard-rows")
    groups = materialize(base.groupBy("_group").agg(F.sum("_size").alias("_bytes")), "shard-groups")
    rows = base.join(_place(groups, shards, block_groups), "_group")
    # slots: a window over a slice of the shard, plus the rows of the slices before it; a row's place in
    # the scan is part of the slice, so rows with one id (or none) spread like others
    slices = max(1, -(-base.count() // (shards * slot_rows)))
    rows = rows.withColumn("_slice", F.pmod(F.xxhash64("_id", "_at"), F.lit(slices)).cast("int"))
    sizes = rows.groupBy("_shard", "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_shard", "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_shard", "_slice").orderBy("_id", "_at")
    ranked = rows.withColumn("_rank", F.row_number().over(within) - 1)
    return ranked.join(starts, ["_shard", "_slice"]).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.col("_shard").alias("shard"), (F.col("_start") + F.col("_rank")).cast("long").alias("slot"))
