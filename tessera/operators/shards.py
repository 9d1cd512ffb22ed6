"""Token shards as chunked tables.

A shard is the concatenation of its documents' token ids in document order. We store it as
``token_chunks(shard, chunk_id, start, ids)``: fixed-size chunks of ``chunk_size`` ids aligned on
``start = chunk_id * chunk_size``. A document never lives in one array per shard, and any offset
range touches a bounded number of chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import bytelevel as BL
from tessera.operators import filters
from tessera.operators.keys import join_null_safe, small
from tessera.operators.materialize import discard, materialize
from tessera.operators.order import composite_key, with_bucket, with_running_sums

CHUNK_SIZE = 4096
DTYPE = "int32"
#: Rows of a batch whose ids are held at once.
ROWS_AT_ONCE = 256


def _safe_slice(arr, start, length):
    """``slice`` with start >= 1 and length >= 0 by construction: Catalyst may evaluate a projection
    before the filter that guards it (pushed/combined predicates), and ANSI mode rejects bad args."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.slice(a, F.greatest(F.lit(1), start).cast("int"), F.greatest(F.lit(0), length).cast("int"))


def pack_offsets(doc_tokens: DataFrame, shard_col: str = "shard", ord_col: str = "ord",
                 ids_col: str = "ids", n_buckets: int | None = None) -> DataFrame:
    """``start`` = tokens of all earlier documents of the same shard (exclusive running sum)."""
    d = doc_tokens.withColumn("n_tokens", F.size(ids_col).cast("bigint"))
    return with_running_sums(d, [ord_col], {"start": F.col("n_tokens")},
                             partition_by=[shard_col], exclusive=True, n_buckets=n_buckets)


PIECE_CHARS = 65536          # text piece length for byte-level tokenisation
EOS_PIECE = 2 ** 31 - 1      # sorts after every real piece of a document


def piece_offsets(pieces: DataFrame, ord_col: str = "ord", piece_col: str = "piece",
                  n_buckets: int | None = None) -> DataFrame:
    """``(shard, start, ids)``: ``start`` = ids of all earlier pieces of the shard by ``(ord, piece)``."""
    d = pieces.withColumn("_n", F.size("ids").cast("bigint"))
    offs = with_running_sums(d, [ord_col, piece_col], {"start": F.col("_n")}, partition_by=["shard"],
                             exclusive=True, n_buckets=n_buckets,
                             bucket_key=composite_key(ord_col, piece_col))
    return offs.select("shard", "start", "ids")


def pack_pieces(pieces: DataFrame, chunk_size: int = CHUNK_SIZE, ord_col: str = "ord",
                piece_col: str = "piece", n_buckets: int | None = None, after: DataFrame | None = None,
                started: DataFrame | None = None) -> DataFrame:
    """W3 at piece level: ``pieces(shard, ord, piece, ids)`` — a document cut into pieces (text
    pieces, words, the EOS) — packed into aligned chunks, in each shard from ``after(shard, tokens)``
    on if given, with the chunks ``started`` before. Instead of ``ids``
    the pieces may have ``bytes`` (see ``bytelevel.raw_pieces``).

    The pieces are written once and shuffled once, to buckets of the order ``(ord, piece)``, so a
    document with a third of the corpus is spread over many. A bucket's first offset is the sum of the
    smaller ones' counts; within it the pieces are read in order and cut at chunk borders as they pass.
    Only the parts of chunks that lie across two buckets are grouped afterwards."""
    raw = "bytes" in pieces.columns
    data, n = ("bytes", F.octet_length("bytes")) if raw else ("ids", F.size("ids"))
    stored = materialize(pieces.select("shard", ord_col, piece_col, data, n.cast("bigint").alias("_n")), "pieces")
    b = with_bucket(stored, ord_col, n_buckets, composite_key(ord_col, piece_col)).withColumn("_shard", F.struct("shard"))
    keys = ["_shard", "_bkt"]
    earlier = Window.partitionBy("_shard").orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy(*keys).agg(F.sum("_n").alias("_n")).select(
        *keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    if after is not None:
        offsets = offsets.join(after.select(F.struct("shard").alias("_shard"), "tokens"), "_shard", "left").select(
            *keys, (F.col("_base") + F.coalesce("tokens", F.lit(0))).alias("_base"))
    placed = b.drop("_n").join(small(offsets, "offsets"), keys).repartition(*keys).sortWithinPartitions(*keys, ord_col, piece_col)
    parts = materialize(placed.select("shard", "_base", data).mapInArrow(
        _cutter(chunk_size, BL.byte_table() if raw else None),
        "shard string, chunk_id long, start long, ids array<int>, whole boolean"), "chunk_parts", "whole")
    discard(stored)
    edges = parts.where("not whole").drop("whole")
    if started is not None:
        edges = edges.unionByName(started)
    return parts.where("whole").drop("whole").unionByName(materialize(to_chunks(edges, chunk_size), "chunk_edges"))


def _cutter(chunk_size: int, table: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Parts of chunks from rows ``(shard, base, ids or bytes)``: rows of one shard and base follow one another."""
    C = chunk_size
    names = ["shard", "chunk_id", "start", "ids", "whole"]

    def part(shard: str | None, start: int, ids: np.ndarray) -> pa.RecordBatch:
        """The ids from ``start`` on, cut at chunk borders."""
        cuts = np.arange((start // C + 1) * C, start + len(ids), C)
        starts = np.concatenate([[start], cuts])
        ends = np.append(cuts, start + len(ids))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]) - start, pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays(
            [pa.array([shard] * len(starts), pa.string()), pa.array(starts // C), pa.array(starts), lists, pa.array(ends - starts == C)], names=names)

    def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column and the offsets of its rows."""
        if table is None:
            lengths, ids = column.value_lengths(), column.flatten().to_numpy(zero_copy_only=False)
        else:
            column = column.cast(pa.large_binary())
            lengths = pc.binary_length(column)
            first = np.frombuffer(column.buffers()[1], np.int64)[column.offset] if len(column) else 0
            total = pc.sum(lengths).as_py() or 0
            ids = table[np.frombuffer(column.buffers()[2], np.uint8)[first:first + total]] if total else table[:0]
        return ids, np.concatenate([[0], np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, at, rest, size = None, 0, [], 0  # the shard and base; where the ids not given out yet start; these ids
        for batch in batches:
            shards, bases = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            k = 0
            for some in _slices(batch.column(2), ROWS_AT_ONCE):
                ids, offsets = flat(some)
                rows = list(zip(shards[k:k + len(some)], bases[k:k + len(some)]))
                k += len(some)
                i = 0
                while i < len(rows):
                    j = i + 1
                    while j < len(rows) and rows[j] == rows[i]:
                        j += 1
                    if rows[i] != run:
                        if size:
                            yield part(run[0], at, np.concatenate(rest))
                        run, at, rest, size = rows[i], rows[i][1], [], 0
                    rest.append(ids[offsets[i]:offsets[j]])
                    size += int(offsets[j] - offsets[i])
                    full = (at + size) // C * C - at  # up to the last border
                    if full > 0:
                        every = np.concatenate(rest)
                        yield part(run[0], at, every[:full])
                        at, rest, size = at + full, [every[full:].copy()], size - full
                    i = j
        if size:
            yield part(run[0], at, np.concatenate(rest))

    return cut


def _slices(column: pa.Array, rows: int) -> Iterator[pa.Array]:
    for k in range(0, len(column), rows):
        yield column.slice(k, rows)


def to_chunks(pieces: DataFrame, chunk_size: int = CHUNK_SIZE, shard_col: str = "shard",
              start_col: str = "start", ids_col: str = "ids") -> DataFrame:
    """Regroup ``(shard, start, ids)`` pieces of a contiguous stream into aligned chunks.

    Every piece is cut at chunk borders (explode over the chunks it covers), then pieces are
    grouped by ``(shard, chunk_id)`` — a group holds at most ``chunk_size`` ids.
    """
    C = chunk_size
    p = pieces.select(F.col(shard_col).alias("shard"), F.col(start_col).cast("bigint").alias("_s"),
                      F.col(ids_col).alias("_ids"))
    p = p.withColumn("_e", F.col("_s") + F.size("_ids")).where(F.col("_e") > F.col("_s"))
    first = F.floor(F.col("_s") / C).cast("bigint")
    last = F.floor((F.col("_e") - 1) / C).cast("bigint")
    p = p.withColumn("chunk_id", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("_s"), F.col("chunk_id") * C)
    hi = F.least(F.col("_e"), (F.col("chunk_id") + 1) * C)
    p = p.select("shard", "chunk_id", lo.alias("_lo"),
                 _safe_slice("_ids", lo - F.col("_s") + 1, hi - lo).alias("_p"))
    g = p.groupBy("shard", "chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("_lo", "_p"))).alias("_ps"))
    return g.select("shard", "chunk_id", (F.col("chunk_id") * C).alias("start"),
                    F.flatten(F.transform("_ps", lambda x: x["_p"])).alias("ids"))


def shard_meta(chunks: DataFrame) -> DataFrame:
    """``(shard, tokens, dtype)``."""
    return chunks.groupBy("shard").agg(F.sum(F.size("ids")).cast("bigint").alias("tokens")) \
        .withColumn("dtype", F.lit(DTYPE))


def upsert_meta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace rows of ``old`` whose shard appears in ``new``, keep the rest."""
    return join_null_safe(old, new.select("shard"), ["shard"], "left_anti").unionByName(new)


def split_counts(meta: DataFrame, train_frac: float = 0.95) -> DataFrame:
    """W4 sizes: ``n_train = max(1, int(n*frac))``, at least one validation token; n < 2 rejected."""
    filters.check_fraction(train_frac)
    n = F.col("tokens")
    n_train = F.greatest(F.lit(1).cast("bigint"), F.floor(n * F.lit(train_frac)).cast("bigint"))
    n_train = F.when(n - n_train < 1, n - 1).otherwise(n_train)
    return meta.select("shard", n.alias("total_before"), n_train.alias("train_tokens"),
                       (n - n_train).alias("val_tokens"))


NULL_SHARD = "<null>"  # stands for a null shard in the name of its validation part


def val_name(shard: Column, suffix: str = "_val") -> Column:
    return F.concat(F.coalesce(shard, F.lit(NULL_SHARD)), F.lit(suffix))


def base_name(shard: Column, suffix: str = "_val") -> Column:
    """The shard that a validation shard was cut from."""
    name = F.substring(shard, F.lit(1), F.char_length(shard) - len(suffix))
    return F.when(name != NULL_SHARD, name)


def split_parts(split: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The training and the validation chunks of :func:`split_chunks`."""
    names = small(counts.select("shard"), "split")
    return join_null_safe(split, names, ["shard"], "left_semi"), join_null_safe(split, names, ["shard"], "left_anti")


def split_chunks(chunks: DataFrame, counts: DataFrame, val_suffix: str = "_val",
                 chunk_size: int = CHUNK_SIZE) -> DataFrame:
    """Token-level prefix/suffix split. Train keeps the shard name, validation becomes
    :func:`val_name` starting at offset 0; both are re-chunked. ``counts`` is one row per
    shard (small), joined on ``shard``.
    """
    bad = counts.where(F.col("total_before") < 2).select("shard").limit(1).collect()
    if bad:
        raise RuntimeError(f"shard too small to split: {bad[0][0]}")
    c = join_null_safe(chunks, small(counts.select("shard", "train_tokens"), "split"), ["shard"])
    end = F.col("start") + F.size("ids")
    k = F.col("train_tokens")
    # the train prefix keeps its alignment: chunks stay where they are, the boundary one is cut
    # (a narrow step); only the validation suffix is shifted to offset 0 and regrouped
    train = c.where(F.col("start") < k).select(
        "shard", "chunk_id", "start", _safe_slice("ids", F.lit(1), F.least(end, k) - F.col("start")).alias("ids"))
    cut = F.greatest(F.col("start"), k)
    val = c.where(end > k).select(
        val_name(F.col("shard"), val_suffix).alias("shard"), (cut - k).alias("start"),
        _safe_slice("ids", cut - F.col("start") + 1, end - cut).alias("ids"))
    return train.unionByName(to_chunks(val, chunk_size))


def vocab_usage(chunks: DataFrame, vocab_size: int) -> DataFrame:
    """A3/U3 per shard: unique ids, coverage %, min and max id."""
    ids = chunks.select("shard", F.explode("ids").alias("id"))
    per_id = ids.groupBy("shard", "id").agg(F.count(F.lit(1)).alias("n"))  # distinct, map-side
    return per_id.groupBy("shard").agg(
        F.lit(vocab_size).alias("vocab_size"),
        F.count(F.lit(1)).alias("unique_ids"),
        F.round(F.count(F.lit(1)) / F.lit(vocab_size) * 100, 2).alias("coverage_pct"),
        F.min("id").alias("min_id"), F.max("id").alias("max_id"))



def epoch_len(meta: DataFrame, context: int) -> DataFrame:
    """``max(1, n // (ctx+1))`` windows per epoch for each shard."""
    filters.check_context(context)
    return meta.select("shard", F.greatest(F.lit(1).cast("bigint"),
                                           F.floor(F.col("tokens") / (context + 1)).cast("bigint"))
                       .alias("epoch_len"))

