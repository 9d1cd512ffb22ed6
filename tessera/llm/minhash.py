"""7. MinHash near-dedup.

Each document's set of word shingles gives ``BANDS * ROWS`` minima under universal hash functions
(multiply, add, shift). Documents with equal sets are folded into their smallest one first, so
copies cost nothing further. Representatives with an equal band share a bucket; there each is
paired with the bucket's hub (a star, not all pairs), pairs are checked on their signatures, then
confirmed on their full sets, and links become components by alternating large-star and
small-star. The hub is the member with the most company over all its buckets, usually the text
that the others were copied from. A document is first confirmed with its most similar hub alone.

A star can miss a link between two members that are both too far from the hub. So buckets that
still hold more than one component are searched again: every member outside the bucket's largest
component meets all members of other components, in blocks of bounded size that only emit pairs
whose signatures agree, each pair once; these signatures are four times as long, because many
pairs here are not much below the limit. Members of one component are never compared, so a large
group of near copies costs about one confirmation each.

With 32 bands of 5 rows a pair at similarity 0.8 shares no bucket with a probability of 3e-6; a
signature falls 4.5 standard deviations short of it about as rarely. Full sets are
made only for members of buckets, and a hub's set is sent once for up to ``CHUNK`` partners.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, prepare
from tessera.llm.components import components
from tessera.llm.rolling import TABLE_LOWER, between, prefix_sums, stir

BANDS, ROWS = 32, 5
CHUNK = 256
#: Block sizes of the second search.
OUTER, INNER = 64, 1024
#: Minima of the long signature, of members of buckets that are searched again.
LONG = 640
#: A signature may fall short of the limit by so many standard deviations.
DEVIATIONS = 4.5
_random = np.random.default_rng(7)
_A = _random.integers(0, 1 << 63, BANDS * ROWS + LONG, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, BANDS * ROWS + LONG, dtype=np.uint64)
_MIX = _random.integers(0, 1 << 63, max(ROWS, 16), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(text: str | None, width: int = 4) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; empty without words. A-Z count as a-z."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    gap = np.concatenate([[True], _SPACE[data], [True]])
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    h = between(prefix_sums(data, TABLE_LOWER), start, end)
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = stir(out * _MIX[k] + h[k:len(h) - n + 1 + k])
    return np.unique(out)


def minima(s: np.ndarray, first: int, last: int) -> np.ndarray:
    """Minima of a set under some of the hash functions: (a x + b) >> 32, in 64 bits."""
    x = s & np.uint64(0xFFFFFFFF)
    a, b = _A[first:last], _B[first:last]
    least = np.full(last - first, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(x), 512):
        room = x[k:k + 512, None] * a
        np.add(room, b, out=room)
        np.minimum(least, room.min(0), out=least)
    return least >> np.uint64(32)


def signature(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (int64) and the low bytes of the bands' minima."""
    least = minima(s, 0, BANDS * ROWS)
    rows = least.reshape(BANDS, ROWS)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = stir(keys * _MIX[k] + rows[:, k])
    return keys.view(np.int64), least.astype(np.uint8)


def _describe(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key, bands, sig = [], [], [], []
            for text in batch.column("_text").to_pylist():
                s = shingles(text, width)
                n.append(len(s))
                if len(s):
                    b, m = signature(s)
                    key.append(hashlib.md5(s.tobytes()).digest())
                    bands.append(b)
                    sig.append(m.tobytes())
                else:
                    key.append(None)
                    bands.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                names=["_id", "_n", "_key", "_bands", "_sig"])
    return run


def _least_agreement(threshold: float, n: int) -> float:
    return threshold - DEVIATIONS * (threshold * (1 - threshold) / n) ** 0.5


def _alike(threshold: float):
    """Pairs whose signatures agree nearly as far as the threshold, with their agreement."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                    for c in ("_sig_u", "_sig_v"))
            same = (a == b).mean(1)
            keep = pa.array(same >= _least_agreement(threshold, BANDS * ROWS))
            yield pa.RecordBatch.from_arrays([batch.column("_u"), batch.column("_v"), pa.array(same)],
                                             names=["_u", "_v", "_same"]).filter(keep)
    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width).tobytes() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sets, pa.binary())], names=["_id", "_set"])
    return run


def _long_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        long = [minima(np.frombuffer(s, np.uint64), BANDS * ROWS, BANDS * ROWS + LONG).astype(np.uint8).tobytes()
                for s in batch.column("_set").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(long, pa.binary())], names=["_id", "_sig"])


def _confirm_rows(percent: int):
    """Rows sorted by hub and part, each hub's own set first: exact similarity of each partner."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, None
        for batch in batches:
            u, v = [], []
            for a, b, data in zip(*(batch.column(c).to_pylist() for c in ("_u", "_v", "_set"))):
                s = np.frombuffer(data, np.uint64)
                if b is None:
                    hub, own = a, s
                    continue
                assert hub == a, "partner without its hub"
                both = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(s) - both):
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, batch.schema.field("_u").type),
                                              pa.array(v, batch.schema.field("_u").type)], names=["_u", "_v"])
    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (_u, _v) whose full shingle sets reach the similarity; sets: (_id, _set)."""
    kind = pairs.schema["_u"].dataType.simpleString()
    counts = materialize(pairs.groupBy(F.col("_u").alias("_hub")).agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("_parts")),
                         "near-parts")
    pairs = (pairs.join(counts, F.col("_u") == F.col("_hub"))
             .select("_u", "_v", F.pmod(F.xxhash64("_v"), F.col("_parts")).alias("_part")))
    hubs = counts.select(F.col("_hub").alias("_u"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)).alias("_part"))
    rows = (hubs.join(sets, F.col("_u") == F.col("_id")).select("_u", "_part", F.lit(None).cast(kind).alias("_v"), "_set")
            .unionByName(pairs.join(sets, F.col("_v") == F.col("_id")).select("_u", "_part", "_v", "_set")))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "_u", "_part").sortWithinPartitions("_u", "_part", F.col("_v").asc_nulls_first())
    return rows.select("_u", "_v", "_set").mapInArrow(_confirm_rows(percent), f"_u {kind}, _v {kind}")


def _search_block(percent: int):
    """Members of other components, in one block: each outer row against the inner rows."""
    least = _least_agreement(percent / 100, LONG)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = frame[frame["_side"] == 0], frame[frame["_side"] == 1]
        out = []
        if len(x) and len(y):
            sx, sy = (np.frombuffer(b"".join(f["_sig"]), np.uint8).reshape(len(f), -1) for f in (x, y))
            bx, by = (np.stack(f["_bands"].to_list()) for f in (x, y))
            here = int(np.flatnonzero(bx[0] == frame["_band"].iloc[0])[0])
            yi, yc, yn, ym = (y[c].to_numpy() for c in ("_id", "_comp", "_n", "_main"))
            for k, (i, c, n) in enumerate(zip(x["_id"], x["_comp"], x["_n"])):
                ok = (yc != c) & (ym | (yi > i)) & (100 * np.minimum(yn, n) >= percent * np.maximum(yn, n))
                ok &= ~(by[:, :here] == bx[k, :here]).any(1)  # else an earlier bucket has the pair
                at = np.flatnonzero(ok)
                at = at[(sy[at] == sx[k]).mean(1) >= least]
                out.extend((i, j) for j in yi[at])
        return pd.DataFrame(out, columns=["_u", "_v"])
    return run


def _across(bands: DataFrame, reps: DataFrame, full: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of different components in buckets that hold several. Buckets of two were
    settled by their star."""
    kind = reps.schema["_id"].dataType.simpleString()
    rows = (bands.where("_c > 2").join(comps.withColumnRenamed("_node", "_id"), "_id", "left")
            .select("_id", "_band", F.coalesce("_component", "_id").alias("_comp")))
    counts = rows.groupBy("_band", "_comp").agg(F.count(F.lit(1)).alias("_k"))
    mixed = (counts.groupBy("_band").agg(F.count(F.lit(1)).alias("_c"), F.sum("_k").alias("_all"),
                                         F.max(F.struct("_k", "_comp")).alias("_m")).where("_c > 1")
             .select(F.col("_band").alias("_mixed"), F.col("_m._comp").alias("_largest"),
                     F.ceil((F.col("_all") - F.col("_m._k")) / OUTER).alias("_xs"),
                     F.ceil(F.col("_all") / INNER).alias("_ys")))
    mixed = materialize(mixed, "near-mixed")
    rows = materialize(rows.join(mixed, F.col("_band") == F.col("_mixed")), "near-again")
    long = (full.join(rows.select(F.col("_id").alias("_again")).distinct(), F.col("_id") == F.col("_again")).select("_id", "_set")
            .mapInArrow(_long_signatures, f"_id {kind}, _sig binary"))
    known = materialize(reps.select("_id", "_n", "_bands").join(long, "_id"), "near-long")
    rows = rows.join(known, "_id")
    rows = rows.withColumn("_main", F.col("_comp") == F.col("_largest"))
    h, zero = F.xxhash64("_id"), F.lit(0).cast("long")
    x = rows.where(~F.col("_main")).withColumn("_xb", F.pmod(h, F.col("_xs"))).withColumn(
        "_yb", F.explode(F.sequence(zero, F.col("_ys") - 1))).withColumn("_side", F.lit(0))
    y = rows.withColumn("_yb", F.pmod(h, F.col("_ys"))).withColumn(
        "_xb", F.explode(F.sequence(zero, F.col("_xs") - 1))).withColumn("_side", F.lit(1))
    columns = ["_band", "_xb", "_yb", "_side", "_id", "_n", "_sig", "_bands", "_comp", "_main"]
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = x.select(*columns).unionByName(y.select(*columns)).repartition(parts, "_band", "_xb", "_yb")
    return both.groupBy("_band", "_xb", "_yb").applyInPandas(_search_block(percent), f"_u {kind}, _v {kind}").distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80,
               width: int = 4) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row.

    Texts without words have empty sets and are linked with nothing. Rows with a null id are
    linked with nothing either: their component is null and they are kept. Repeated rows have
    equal sets, so they share a component (all rows with its smallest id are kept). Two rows with
    one id but different texts are both found equal to other rows, but near links are sought for
    one of them only (ids name documents). Other columns are not read. An empty table gives an
    empty table.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()
    sets = materialize(base.mapInArrow(
        _describe(width), f"_id {kind}, _n long, _key binary, _bands array<long>, _sig binary"), "near-sets")
    linked = sets.where("_key is not null and _id is not null")
    first = materialize(linked.groupBy("_key").agg(F.min("_id").alias("_rep")), "near-first")
    one = first.groupBy("_rep").agg(F.min("_key").alias("_k"))
    reps = materialize(linked.join(one, (F.col("_id") == F.col("_rep")) & (F.col("_key") == F.col("_k")))
                       .select("_id", "_n", "_bands", "_sig").dropDuplicates(["_id"]), "near-reps")
    bands = reps.select("_id", F.explode("_bands").alias("_band"))
    sizes = materialize(bands.groupBy("_band").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
                        .select(F.col("_band").alias("_bucket"), "_c"), "near-sizes")
    shared = materialize(bands.join(sizes, F.col("_band") == F.col("_bucket")).select("_id", "_band", "_c"), "near-buckets")
    # a bucket's hub: its member with the most company over all of its buckets
    company = shared.groupBy(F.col("_id").alias("_m")).agg(F.sum("_c").alias("_company"))
    hubs = materialize(shared.join(company, F.col("_id") == F.col("_m")).groupBy(F.col("_band").alias("_bucket"))
                       .agg(F.max(F.struct("_company", "_id")).alias("_h")).select("_bucket", F.col("_h._id").alias("_hub")),
                       "near-hubs")
    star = (shared.join(hubs, F.col("_band") == F.col("_bucket")).where("_id <> _hub")
            .select(F.col("_hub").alias("_u"), F.col("_id").alias("_v")).distinct())
    info = reps.select("_id", "_n", "_sig")
    star = (star.join(info.toDF("_iu", "_n_u", "_sig_u"), F.col("_u") == F.col("_iu"))
            .join(info.toDF("_iv", "_n_v", "_sig_v"), F.col("_v") == F.col("_iv"))
            .where(F.least("_n_u", "_n_v") * 100 >= F.greatest("_n_u", "_n_v") * percent))
    star = materialize(star.select("_u", "_v", "_sig_u", "_sig_v")
                       .mapInArrow(_alike(percent / 100), f"_u {kind}, _v {kind}, _same double"), "near-star")
    # full sets of all that a pair can name: members of buckets
    named = shared.select(F.col("_id").alias("_need")).distinct()
    full = materialize(base.join(named.hint("merge"), F.col("_id") == F.col("_need")).select("_id", "_text")
                       .mapInArrow(_full_sets(width), f"_id {kind}, _set binary"), "near-full")
    # first the most similar hub of each document, then what is still apart
    nearest = materialize(star.groupBy("_v").agg(F.max(F.struct("_same", "_u")).alias("_h"))
                          .select(F.col("_h._u").alias("_u"), "_v"), "near-nearest")
    links = materialize(confirm(nearest, full, percent), "near-links")
    comps = materialize(components(links), "near-comps")
    apart = star.join(comps.toDF("_nu", "_cu"), F.col("_u") == F.col("_nu"), "left").join(
        comps.toDF("_nv", "_cv"), F.col("_v") == F.col("_nv"), "left").where(
        F.coalesce("_cu", "_u") != F.coalesce("_cv", "_v")).select("_u", "_v")
    more = apart.unionByName(_across(shared, reps, full, comps, percent)).select(
        F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v")).distinct()
    tried = nearest.select(F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v"))
    more = materialize(more.join(tried, ["_u", "_v"], "left_anti"), "near-more")
    links2 = materialize(confirm(more, full, percent), "near-links2")
    if links2.take(1):
        comps = materialize(components(links.unionByName(links2)), "near-comps2")
    out = (sets.join(first.select(F.col("_key").alias("_k"), "_rep"), F.col("_key") == F.col("_k"), "left")
           .join(comps.toDF("_node", "_comp"), F.col("_rep") == F.col("_node"), "left"))
    comp = F.when(F.col("_id").isNotNull(), F.coalesce("_comp", "_rep", "_id"))
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), comp.alias("component_id"),
                      F.coalesce(F.col("_id") == comp, F.lit(True)).alias("kept"))
