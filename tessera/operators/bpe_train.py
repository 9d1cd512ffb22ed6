"""Training a byte-level BPE vocabulary in rounds of many merges.

The distinct words stay in one table ``(word, cnt, ids)``, the pair counts in another. A round

1. takes the best pairs, ``top_pairs`` at first, (count descending, ids ascending) and the best pair beyond;
2. cuts every word into runs, its longest stretches in which each neighbouring pair is one of them,
   and adds the runs up over all words: a table of few, short id sequences;
3. merges on the driver, on these runs alone, with an index from pairs to the runs that hold them
   and a heap over their counts, for as long as the best pair comes before the best pair beyond;
4. applies the accepted merges to the words, and changes the pair counts by what the changed words
   lose and gain.

Why this is exact. A pair across the border of two runs is made, before any merge of the round, of
a pair that is not among the best, and each new token of a round has one decomposition into the
symbols at its start (a merge that spells a token that exists already ends the round). So a pair
type occurs either within runs only, and the runs count it exactly, or across borders only. Then it
counts at most as much as the pair it came from, and its ids are not smaller, so it does not come
before the best pair beyond. Ties are ordered like all other pairs.

A pass over the words is a map without a shuffle that looks only at neighbouring ids; Python
handles the words that hold an accepted pair, and only those are exploded into pairs. Words of one
symbol leave the table. The driver holds the runs of one round: where they are more than
``max_run_ids`` ids the round is done with half the pairs, where they are far fewer the next takes
twice as many. The number of pairs changes the number of rounds, never a merge.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import bytelevel as BL
from tessera.operators.materialize import discard, materialize

Pair = tuple[int, int]
_STATE = "word string, cnt long, ids array<int>, was array<int>"


def merge_ids(ids: list[int], ranks: dict[Pair, tuple[int, int]]) -> list[int]:
    """Merge the neighbouring pair of least rank (leftmost first) until none has a rank; a heap over
    the pairs keeps a word of n symbols at n log n. ``ranks``: pair to (rank, id of the result)."""
    n = len(ids)
    heap = [(*r, k) for k, p in enumerate(zip(ids, ids[1:])) if (r := ranks.get(p))]
    if not heap:
        return ids
    ids = list(ids)
    after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
    heapq.heapify(heap)
    while heap:
        rank, new, k = heapq.heappop(heap)
        j = after[k]
        if ids[k] < 0 or j >= n or ranks.get((ids[k], ids[j]), (-1,))[0] != rank:
            continue  # one of the two was merged since
        ids[k], ids[j] = new, -1
        after[k] = after[j]
        if after[j] < n:
            prior[after[j]] = k
        for a in (prior[k], k):
            if a >= 0 and after[a] < n and (r := ranks.get((ids[a], ids[after[a]]))):
                heapq.heappush(heap, (*r, a))
    return [i for i in ids if i >= 0]


def _neighbours(ids: pa.ListArray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat ids, offsets of the lists, and whether each place and the next, of one list, are one of
    ``pairs`` (sorted keys)."""
    offsets = ids.offsets.to_numpy()
    flat = ids.values.to_numpy(zero_copy_only=False).astype(np.int64)
    keys = (flat[:-1] << 32) | flat[1:]
    at = np.searchsorted(pairs, keys)
    hit = np.zeros(len(flat), bool)
    hit[:-1] = pairs[np.minimum(at, len(pairs) - 1)] == keys
    ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    hit[ends] = False
    return flat, offsets, hit


def _keys(pairs) -> np.ndarray:
    return np.sort(np.array([(a << 32) | b for a, b in pairs], np.int64))


def pair_counts(words: DataFrame, ids: str = "ids", cnt: str = "cnt") -> DataFrame:
    """``(left, right, cnt)``: neighbouring ids of ``words``, weighted by word count."""
    n = F.size(ids) - 1
    pairs = F.arrays_zip(F.slice(ids, 1, n).alias("left"), F.slice(ids, 2, n).alias("right"))
    return (words.where(F.size(ids) > 1).select(F.col(cnt), F.explode(pairs).alias("p"))
            .groupBy("p.left", "p.right").agg(F.sum(cnt).alias("cnt")))


def runs(words: DataFrame, pairs: list[Pair]) -> DataFrame:
    """``(run, cnt)``: the longest stretches of words whose neighbours are all among ``pairs``."""
    keys = _keys(pairs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, offsets, hit = _neighbours(batch.column("ids"), keys)
            edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
            counts = batch.column("cnt").to_numpy()[np.searchsorted(offsets, starts, "right") - 1]
            found: Counter = Counter()
            flat = flat.astype(np.int32)
            for a, b, n in zip(starts.tolist(), ends.tolist(), counts.tolist()):
                found[flat[a:b].tobytes()] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                                             names=["run", "cnt"])

    return words.select("cnt", "ids").mapInArrow(cut, "run binary, cnt long").groupBy("run").agg(F.sum("cnt").alias("cnt"))


def apply_merges(words: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """Words after ``merges`` (left, right, new id; in order); ``was`` has the ids before if they changed."""
    ranks = {(a, b): (k, new) for k, (a, b, new) in enumerate(merges)}
    keys, kind = _keys(ranks), pa.list_(pa.int32())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("ids")
            flat, offsets, hit = _neighbours(ids, keys)
            touched = np.flatnonzero(np.add.reduceat(np.append(hit, False), offsets[:-1]) * (np.diff(offsets) > 0))
            # only the touched words become Python lists, equal ones once; the others are taken as they are
            done: dict[bytes, int] = {}
            merged, place = [], np.arange(len(ids))
            for k in touched.tolist():
                own = flat[offsets[k]:offsets[k + 1]]
                at = done.setdefault(own.tobytes(), len(done))
                if at == len(merged):
                    merged.append(merge_ids(own.tolist(), ranks))
                place[k] = len(ids) + at
            new = pa.concat_arrays([ids, pa.array(merged, ids.type)]).take(pa.array(place))
            was = ids.take(pa.array(np.arange(len(ids)), mask=place < len(ids)))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("cnt"), new.cast(kind), was.cast(kind)],
                                             names=["word", "cnt", "ids", "was"])

    return words.select("word", "cnt", "ids").mapInArrow(step, _STATE)


class Runs:
    """Pair counts of weighted id sequences, with an index from pairs to sequences and a heap."""

    def __init__(self, found: list[tuple[list[int], int]]):
        self.runs, self.weights = [r for r, _ in found], [n for _, n in found]
        self.counts: Counter = Counter()
        self.holders: dict[Pair, set[int]] = defaultdict(set)
        for k, run in enumerate(self.runs):
            for p in zip(run, run[1:]):
                self.counts[p] += self.weights[k]
                self.holders[p].add(k)
        self.heap = [(-n, *p) for p, n in self.counts.items()]
        heapq.heapify(self.heap)

    def best(self) -> tuple[int, int, int] | None:
        """(-count, left, right) of the pair that comes first."""
        while self.heap:
            n, a, b = self.heap[0]
            if self.counts.get((a, b)) == -n:
                return n, a, b
            heapq.heappop(self.heap)
        return None

    def merge(self, a: int, b: int, new: int) -> None:
        changed = set()
        for k in self.holders.pop((a, b)):
            run, weight, out, i = self.runs[k], self.weights[k], [], 0
            while i < len(run):
                if run[i] == a and i + 1 < len(run) and run[i + 1] == b:
                    out.append(new)
                    i += 2
                else:
                    out.append(run[i])
                    i += 1
            for p in zip(run, run[1:]):
                self.counts[p] -= weight
                changed.add(p)
                self.holders[p].discard(k) if p in self.holders else None
            for p in zip(out, out[1:]):
                self.counts[p] += weight
                changed.add(p)
                self.holders[p].add(k)
            self.runs[k] = out
        for p in changed:
            n = self.counts[p]
            if n > 0:
                heapq.heappush(self.heap, (-n, *p))
            else:
                del self.counts[p]


class Tokens:
    """Token strings by id and the merges so far."""

    def __init__(self) -> None:
        self.tokens = list(BL.SPECIAL_TOKENS) + sorted(BL.BYTE_CHARS, key=ord)
        self.ids = {t: i for i, t in enumerate(self.tokens)}
        self.merges: list[tuple[int, str, str, int]] = []

    def add(self, a: int, b: int) -> tuple[int, bool]:
        """Id of the merged pair, and whether its token existed before."""
        token = self.tokens[a] + self.tokens[b]
        known = token in self.ids
        if not known:
            self.ids[token] = len(self.tokens)
            self.tokens.append(token)
        self.merges.append((len(self.merges), self.tokens[a], self.tokens[b], self.ids[token]))
        return self.ids[token], known


def one_round(found: Runs, beyond: tuple[int, int, int] | None, tokens: Tokens, vocab_size: int, max_merges: int,
              min_frequency: int) -> list[tuple[int, int, int]]:
    """Accept merges while the best pair of the runs comes before the best pair ``beyond`` them."""
    accepted: list[tuple[int, int, int]] = []
    while len(tokens.tokens) < vocab_size and len(tokens.merges) < max_merges:
        best = found.best()
        if best is None or -best[0] < min_frequency or (beyond is not None and best > beyond):
            break
        _, a, b = best
        new, known = tokens.add(a, b)
        accepted.append((a, b, new))
        if known:
            break
        found.merge(a, b, new)
    return accepted


def train_tables(words: DataFrame, vocab_size: int, min_frequency: int = 2, max_merges: int | None = None,
                 top_pairs: int = 64, max_run_ids: int = 200_000) -> tuple[Tokens, DataFrame, int]:
    """Tokens and merges, ``(word, cnt, ids)`` of all words after the last merge, and the rounds."""
    limit = 1 << 62 if max_merges is None else max_merges
    tokens, rounds = Tokens(), 0
    state = materialize(words.select("word", F.col("cnt").cast("long").alias("cnt"), BL.base_ids("word").alias("ids")), "bpe-words")
    counts = materialize(pair_counts(state), "bpe-pairs")
    finished: list[DataFrame] = []
    k = top_pairs
    while len(tokens.tokens) < vocab_size and len(tokens.merges) < limit:
        top = [(-r["cnt"], r["left"], r["right"]) for r in counts.where(F.col("cnt") >= min_frequency)
               .orderBy(F.desc("cnt"), "left", "right").limit(k + 1).collect()]
        if not top:
            break
        while True:
            inside, beyond = [p[1:] for p in top[:k]], top[k] if len(top) > k else None
            table = runs(state, inside).persist()
            size = table.agg(F.coalesce(F.sum(F.octet_length("run") / 4), F.lit(0))).first()[0]
            if size <= max_run_ids or k == 1:
                break
            table.unpersist()
            k = max(1, k // 2)
        found = Runs([(np.frombuffer(r["run"], np.int32).tolist(), r["cnt"]) for r in table.collect()])
        table.unpersist()
        if size < max_run_ids / 4:  # room for more pairs in the next round
            k *= 2
        accepted = one_round(found, beyond, tokens, vocab_size, limit, min_frequency)
        rounds += 1
        after = materialize(apply_merges(state, accepted), "bpe-words")
        changed = after.where("was is not null")
        delta = pair_counts(changed.select(F.explode(F.array(
            F.struct((-F.col("cnt")).alias("cnt"), F.col("was").alias("ids")),
            F.struct("cnt", "ids"))).alias("v")).select("v.*"))
        now = materialize(counts.unionByName(delta).groupBy("left", "right").agg(F.sum("cnt").alias("cnt")).where("cnt > 0"), "bpe-pairs")
        discard(counts)
        counts = now
        lone = after.where(F.size("ids") < 2).select("word", "cnt", "ids")
        if rounds % 8 == 0:  # words of one symbol never change again
            finished.append(materialize(lone, "bpe-finished"))
            kept = materialize(after.where(F.size("ids") > 1).select("word", "cnt", "ids"), "bpe-words")
            discard(after)
            after = kept
        discard(state)
        state = after
    for f in finished:
        state = state.select("word", "cnt", "ids").unionByName(f)
    return tokens, state.select("word", "cnt", "ids"), rounds
