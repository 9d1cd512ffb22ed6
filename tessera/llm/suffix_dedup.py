"""8. Suffix-array dedup: bytes covered by a 200-byte string that also starts somewhere else go.

Finding what has to be sorted. Every 200-byte window has an anchor, the window's 32-byte string of
smallest hash (leftmost of equals). Equal windows have equal anchors, so windows can only be equal
within an anchor's occurrences. Neighbouring windows with one anchor form a snippet. Anchors are
counted (partial aggregation); for those found twice or more, snippets are counted:
* a snippet found more than once is repeated in all of its windows, bytes unseen;
* an anchor with several different snippets, at least one of them found once, needs their bytes.

Sorting. The distinct snippets of an anchor come to one task, which sorts the suffixes of a block
of anchors by linear grouping (``suffix_groups``). The sequence consists of byte strings that end
in one of a few separator bytes, chosen by their frequency in the block; such strings are free of
prefixes, so their order is the order of the bytes. Suffixes that share enough bytes are
neighbours, and a window that starts inside a string is told by its own bytes before the next
suffix and by that suffix's class. All comparisons are exact to the byte.

An anchor with more than ``MAX_KINDS`` distinct snippets isn't sent to one task. Its windows are
counted one by one by their 128-bit hash instead, which Spark spreads over all tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, materialize, prepare
from tessera.llm.rolling import between, prefix_sums, stir
from tessera.llm.suffix_groups import suffix_array

WINDOW, GRAM = 200, 32
MAX_KINDS = 4096
#: Bytes of one sorted block, and window starts of one pass over a long text.
BLOCK, PASS = 1 << 18, 1 << 20
_U = np.uint64


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` values (block-wise prefix and suffix minima)."""
    n = len(h)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, _U)
    padded[:n] = h
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def snippets(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor: anchor hash, first start, starts, anchor's offset."""
    parts = []
    width = WINDOW - GRAM + 1
    whole = np.frombuffer(data, np.uint8)
    for begin in range(0, len(data) - WINDOW + 1, PASS):
        piece = whole[begin:begin + PASS + WINDOW - 1]
        prefix = prefix_sums(piece)
        at = np.arange(len(piece) - GRAM + 1)
        h = between(prefix, at, at + GRAM)
        # hash above, place below: equal hashes fall to the leftmost
        packed = (h & ~_U((1 << 21) - 1)) | at.astype(_U)
        best = (_least(packed, width) & _U((1 << 21) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        count = np.diff(np.concatenate([first, [len(best)]]))
        anchor = best[first]
        parts.append((h[anchor].view(np.int64), first + begin, count, anchor - first))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [snippets((t or "").encode())[0] for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], names=["_anchor"])


_OCCURRENCES = "_text_key binary, _anchor long, _snippet long, _start long, _count int, _offset int"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[] for _ in range(6)]
        for text in batch.column(0).to_pylist():
            data = (text or "").encode()
            anchor, start, count, offset = snippets(data)
            if not len(anchor):
                continue
            key = hashlib.md5(data).digest()
            hashes = [xxhash.xxh3_64_intdigest(data[s:e]) for s, e in
                      zip(start.tolist(), (start + count + WINDOW - 1).tolist())]
            for c, x in zip(columns, ([key] * len(anchor), anchor, np.array(hashes, _U).view(np.int64), start, count, offset)):
                c.append(x)
        flat = [[k for x in columns[0] for k in x]] + [np.concatenate(c) if c else [] for c in columns[1:]]
        types = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(flat, types)],
                                         names=["_text_key", "_anchor", "_snippet", "_start", "_count", "_offset"])


def _common(data: bytes, goal: float) -> list[int]:
    """Bytes that make up about ``goal`` of the data, none of them more than that alone."""
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    chosen, total = [], 0.0
    for b in np.argsort(-share, kind="stable").tolist():
        if total < goal and 0 < share[b] <= 0.6 * goal:
            chosen.append(b)
            total += share[b]
    return chosen


def _strings(texts: list[bytes]) -> list[list[bytes]]:
    """Each text cut after every separator byte; separators make strings of 14 bytes on average."""
    chosen = _common(b"".join(texts), 1 / 14)
    if not chosen:
        return [[t] for t in texts]
    kind = b"".join(re.escape(bytes([b])) for b in chosen)
    cut = re.compile(b"[^" + kind + b"]*[" + kind + b"]|[^" + kind + b"]+", re.S)
    return [cut.findall(t) for t in texts]


def _blocks(rows: list[tuple]) -> Iterator[tuple[list[tuple], list[list[bytes]]]]:
    """Rows (anchor first, bytes last) and their strings, all shorter than a window. Anchors with
    a longer string get a block of their own kind, with other separators; in the end all bytes of
    a single anchor are separators."""
    strings = _strings([r[-1] for r in rows])
    odd = {r[0] for r, p in zip(rows, strings) if max(map(len, p)) >= WINDOW}
    good = [(r, p) for r, p in zip(rows, strings) if r[0] not in odd]
    rest = [r for r in rows if r[0] in odd]
    if good:
        yield [r for r, _ in good], [p for _, p in good]
    if good and rest:
        yield from _blocks(rest)
    elif len(odd) == 1:
        yield rest, [[t[k:k + 1] for k in range(len(t))] for *_, t in rest]
    elif rest:
        names = sorted(odd)
        low = set(names[:len(names) // 2])
        yield from _blocks([r for r in rest if r[0] in low])
        yield from _blocks([r for r in rest if r[0] not in low])


def repeated_starts(parts: list[list[bytes]]) -> np.ndarray:
    """For each byte of the joined texts, given as strings, whether the window that starts there
    (and lies in one text) is found at another place too. Texts have at least ``WINDOW`` bytes."""
    texts = [b"".join(p) for p in parts]
    names = {s: k for k, s in enumerate(sorted({s for p in parts for s in p}), len(texts))}
    sequence: list[int] = []
    start, size_before, real = [], [], []
    stop = []
    at = 0
    for k, (text, strings) in enumerate(zip(texts, parts)):
        before = 0
        for s in strings:
            sequence.append(names[s])
            start.append(at)
            size_before.append(before)
            real.append(before > 0)
            stop.append(0)
            at += len(s)
            before = len(s)
        sequence.append(len(texts) - 1 - k)  # ends sort below all strings, the last one lowest
        start.append(at)
        size_before.append(0)
        real.append(False)
        stop[-len(strings):] = [at] * len(strings)
        stop.append(at)
    data = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
    order = np.array(suffix_array(sequence))
    order = order[np.array(real)[order]]
    begin, end = np.array(start)[order], np.array(stop)[order]
    before = np.array(size_before)[order]
    # shared bytes of neighbouring suffixes, up to a window
    rows = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
    shared = np.zeros(len(order), np.int64)
    for k in range(1, len(order), 4096):
        a, b = begin[k - 1:min(k + 4095, len(order) - 1)], begin[k:k + 4096]
        unequal = rows[a] != rows[b]
        length = np.where(unequal.any(1), unequal.argmax(1), WINDOW)
        shared[k:k + 4096] = np.minimum(length, np.minimum(end[k - 1:k - 1 + len(b)] - a, end[k:k + 4096] - b))
    prefix = prefix_sums(data)
    keys, places = [], []
    for ahead in range(1, int(before.max(initial=0)) + 1):
        # windows that start ``ahead`` bytes before a suffix: own bytes and class of the rest
        some = np.flatnonzero((before >= ahead) & (begin - ahead + WINDOW <= end))
        if not len(some):
            continue
        kind = np.cumsum(shared < WINDOW - ahead)[some].astype(_U)
        p = begin[some] - ahead
        keys.append(stir(between(prefix, p, p + ahead) + kind * _U(0xD6E8FEB86659FD93)) + _U(ahead))
        places.append(p)
    out = np.zeros(len(data) - WINDOW, bool)
    if keys:
        key, place = np.concatenate(keys), np.concatenate(places)
        _, at, count = np.unique(key, return_inverse=True, return_counts=True)
        out[place[count[at] > 1]] = True
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


_RANGES = "_text_key binary, _from long, _to long"


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: whole anchors are gathered up to a block, then sorted. Gives the
    ranges of repeated window starts of snippets that were found once."""
    def flush(held):
        out = []
        for rows, strings in _blocks(held):
            flags, at = repeated_starts(strings), 0
            for _, key, start, times, text in rows:
                if times == 1:
                    out.extend((key, start + a, start + b) for a, b in _runs(flags[at:at + len(text) - WINDOW + 1]))
                at += len(text)
        keys, lows, highs = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lows, pa.int64()),
                                           pa.array(highs, pa.int64())], names=["_text_key", "_from", "_to"])

    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("_anchor", "_text_key", "_start", "_times", "_bytes"))):
            if held and size >= BLOCK and row[0] != held[-1][0]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield flush(held)


def _cut(texts: pd.Series, wanted: pd.Series) -> pd.Series:
    out = []
    for text, some in zip(texts, wanted):
        data = (text or "").encode()
        out.append([{"_anchor": w["_anchor"], "_start": w["_start"], "_times": w["_times"], "_kinds": w["_kinds"],
                     "_bytes": data[w["_start"]:w["_start"] + w["_count"] + WINDOW - 1]} for w in some])
    return pd.Series(out)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of a snippet by its 128-bit hash."""
    for batch in batches:
        key, start, times, hashes = [], [], [], []
        for k, s, t, data in zip(*(batch.column(c).to_pylist() for c in ("_text_key", "_start", "_times", "_bytes"))):
            n = len(data) - WINDOW + 1
            key.extend([k] * n)
            start.extend(range(s, s + n))
            times.extend([t] * n)
            hashes.extend(xxhash.xxh3_128_digest(data[j:j + WINDOW]) for j in range(n))
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(start, pa.int64()), pa.array(times, pa.int64()),
                                          pa.array(hashes, pa.binary())], names=["_text_key", "_start", "_times", "_hash"])


def _remove(texts: pd.Series, ranges: pd.Series) -> pd.DataFrame:
    rows = []
    for text, some in zip(texts, ranges):
        data = (text or "").encode()
        spans: list[list[int]] = []
        for a, b in sorted((r["_from"], r["_to"] + WINDOW - 1) for r in some) if some is not None else ():
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        edges = [0, *(x for s in spans for x in s), len(data)]
        kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
        rows.append((len(data), len(data) - len(kept), len(spans), kept))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])


def repeats(docs: DataFrame, text_col: str = "text", max_kinds: int = MAX_KINDS) -> DataFrame:
    """(_text_key, _from, _to): ranges of starts of repeated windows, by the MD5 of the text."""
    spark = docs.sparkSession
    text = docs.select(F.col(text_col).alias("_text"))
    counts = (text.mapInArrow(_anchors, "_anchor long").groupBy("_anchor").agg(F.count(F.lit(1)).alias("_n"))
              .where("_n > 1").select(F.col("_anchor").alias("_repeated")))
    counts = materialize(counts, "repeat-anchors")
    found = text.mapInArrow(_occurrences, _OCCURRENCES).join(counts, F.col("_anchor") == F.col("_repeated")).drop("_repeated")
    found = materialize(found, "repeat-found")
    kinds = materialize(found.groupBy("_anchor", "_snippet", "_offset", "_count").agg(
        F.count(F.lit(1)).alias("_times"), F.min(F.struct("_text_key", "_start")).alias("_at")), "repeat-kinds")
    several = kinds.where("_times > 1").select(F.col("_anchor").alias("_a"), F.col("_snippet").alias("_s"),
                                               F.col("_offset").alias("_o"), F.col("_count").alias("_c"))
    sure = (found.join(several, (F.col("_anchor") == F.col("_a")) & (F.col("_snippet") == F.col("_s"))
                       & (F.col("_offset") == F.col("_o")) & (F.col("_count") == F.col("_c")))
            .select("_text_key", F.col("_start").alias("_from"), (F.col("_start") + F.col("_count")).alias("_to")))
    unsure = materialize(kinds.groupBy("_anchor").agg(F.count(F.lit(1)).alias("_kinds"), F.min("_times").alias("_m"))
                         .where("_kinds > 1 and _m = 1").select(F.col("_anchor").alias("_open"), "_kinds"), "repeat-open")
    wanted = (kinds.join(unsure, F.col("_anchor") == F.col("_open"))
              .groupBy(F.col("_at._text_key").alias("_want"))
              .agg(F.collect_list(F.struct("_anchor", F.col("_at._start").alias("_start"), "_count", "_times", "_kinds"))
                   .alias("_wanted")))
    # copies of a text: one of them is enough to cut from
    keyed = text.select(F.unhex(F.md5(F.coalesce("_text", F.lit("")))).alias("_text_key"), "_text")
    cutter = F.pandas_udf(_cut, "array<struct<_anchor:long,_start:long,_times:long,_kinds:long,_bytes:binary>>")
    cut = (keyed.join(wanted, F.col("_text_key") == F.col("_want"))
           .select("_text_key", F.explode(cutter("_text", "_wanted")).alias("c")).select("_text_key", "c.*"))
    cut = materialize(cut.dropDuplicates(["_text_key", "_start", "_anchor"]), "repeat-cut")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = (cut.where(F.col("_kinds") <= max_kinds).repartition(parts, "_anchor").sortWithinPartitions("_anchor")
              .mapInArrow(_sort_blocks, _RANGES))
    windows = materialize(cut.where(F.col("_kinds") > max_kinds)
                          .mapInArrow(_windows, "_text_key binary, _start long, _times long, _hash binary"), "repeat-windows")
    twice = materialize(windows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
                        .select(F.col("_hash").alias("_twice")), "repeat-twice")
    hot = (windows.where("_times = 1").join(twice, F.col("_hash") == F.col("_twice"))
           .select("_text_key", F.col("_start").alias("_from"), (F.col("_start") + 1).alias("_to")))
    return sure.unionByName(blocks).unionByName(hot)


def remove_repeats(docs: DataFrame, text_col: str = "text", max_kinds: int = MAX_KINDS) -> DataFrame:
    """All columns of ``docs`` plus ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes;
    input columns of those names are replaced).

    Null and empty texts have no bytes; texts shorter than a window lose nothing. Repeated rows
    are copies of each other, so with a window or more they lose everything. Ids are not read, so
    null ids do no harm. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    prepare(spark)
    key, cut, found, made = (free_name(x, docs.columns) for x in ("_text_key", "_cut_key", "_ranges", "_r"))
    ranges = repeats(docs, text_col, max_kinds)
    ranges = ranges.groupBy(F.col("_text_key").alias(cut)).agg(F.collect_set(F.struct("_from", "_to")).alias(found))
    rest = [c for c in docs.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    remove = F.pandas_udf(_remove, "n_bytes long, n_removed long, n_spans long, kept binary")
    out = keyed.join(ranges, F.col(key) == F.col(cut), "left")
    return out.select(*rest, remove(F.col(text_col), F.col(found)).alias(made)).select(*rest, f"{made}.*")
