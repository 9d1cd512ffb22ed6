"""6. Toxicity: noisy-channel deobfuscation, then a score of the restored text.

Every token with a look-alike (0 for o) or a doubled letter, and every run of short letter groups of
which one is a single character (s t u p i d, st u p id), becomes a lattice of characters; a Viterbi
search under a character trigram model picks the reading: a look-alike stands for a letter, a
repetition or a separator may be dropped. The reading is taken if it is likelier than the token as it
stands, a disguise being a matter of one token in ``1 / exp(DISGUISED)``. The trigram model counts the
characters of all documents (an alphabet of 64 codes, so at most 64^3 counters reach the driver however
large the corpus is).

Words and word beginnings that mark toxic documents are learned from at most ``FIT_DOCS`` labelled
rows, in the order of a hash of their ids and never from held-out rows; of these at most
``FEATURES`` are kept. A logistic regression on the strongest mark and on the number of marks gives
the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, prepare

FIT_DOCS, FEATURES = 20_000, 2_000
#: Fixed: look-alikes and the letters that they may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
_CODE = {c: k for k, c in enumerate(_LETTERS, 1) if c != "\xf7"}
_DIGIT, _SIGN = 60, 61
_CODES = _CODE | {c: _DIGIT if c.isdigit() else _SIGN for c in LEET}
_SIZE = 64
DISGUISED = math.log(0.3)
_CACHE = 300_000
_ONE = "[0-9a-z\xdf-\xf6\xf8-\xff@$!|+]"
_EDGE, _END = r"(?<![^\W_])(?<![@$!|+])", r"(?![^\W_]|[@$!|+])"
_LONE = re.compile(_EDGE + _ONE + _END)
_RUN = re.compile(rf"{_EDGE}(?:{_ONE}{{1,3}}[ .,\-_*/]{{1,3}})+{_ONE}{{1,3}}{_END}")
_UNITS = re.compile(rf"{_ONE}+|[ .,\-_*/]+")
_SUSPECT = re.compile(r"[0-9@$!|+]|([^\W\d_])\1")
_LETTER = re.compile(r"[^\W\d_]")
_WORDS = re.compile(r"[^\W\d_]+")


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(256, np.int64)
    for c, k in _CODES.items():
        table[ord(c)] = k
    sums = np.zeros(_SIZE ** 3, np.int64)
    for batch in batches:
        text = "\n\n".join((t or "").lower() for t in batch.column(0).to_pylist())
        codes = table[np.frombuffer(("\n\n" + text + "\n").encode("latin-1", "replace"), np.uint8)]
        sums += np.bincount(codes[:-2] * _SIZE * _SIZE + codes[1:-1] * _SIZE + codes[2:], minlength=_SIZE ** 3)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["_at", "_n"])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log P(c | a, b) over all texts as an array [a, b, c]; all digits are one code, so are
    all signs that look like letters; code 0 is anything else."""
    rows = (docs.select(text_col).mapInArrow(_count_trigrams, "_at long, _n long")
            .groupBy("_at").agg(F.sum("_n").alias("_n")).collect())
    counts = np.full(_SIZE ** 3, 0.1)
    for r in rows:
        counts[r["_at"]] += r["_n"]
    counts = counts.reshape(_SIZE, _SIZE, _SIZE)
    return np.log(counts / counts.sum(2, keepdims=True))


_FLAT: list = [None, []]


def _flat(logp: np.ndarray) -> list[float]:
    """The model as a list, which is read faster one by one; that of the last model is kept."""
    if _FLAT[0] is not logp:
        _FLAT[:] = logp, logp.ravel().tolist()
    return _FLAT[1]


#: Log probability of a character that stands for itself given its code, of a look-alike, of a repetition.
_KEPT = [math.log(0.9)] * _DIGIT + [math.log(0.1), math.log(0.2)]
_LOOKS, _REPEAT = math.log(0.7), math.log(0.2)
#: How likely a separator is dropped in a disguised run: between groups, beside one or two single
#: characters, at the edge of three or more, between single characters.
_BETWEEN, _BESIDE, _EDGES, _SINGLE = 0.1, 0.5, 0.01, 0.97


def decode(units: Sequence[str], logp: np.ndarray, dropped: Mapping[int, float] | None = None) -> str:
    """Most likely reading of a token, which is the token itself unless another one is likelier by
    more than a disguise is rare. A state is the last two codes that were emitted; each observed
    character may be read as itself or a look-alike, or dropped if it repeats the one before.
    ``dropped`` has the units that are separators, and how likely each is dropped in a disguise.
    Readings are linked lists, so that long tokens take linear time."""
    model, top, dropped = _flat(logp), _SIZE * _SIZE, dropped or {}
    states: dict[int, tuple[float, tuple | None]] = {0: (DISGUISED, None)}
    plain, at, before = 0.0, 0, ""
    for k, ch in enumerate(units):
        code = _CODES.get(ch, 0)
        cost = 0.0 if k in dropped else _KEPT[code]
        plain += cost + model[at * _SIZE + code]
        at = (at * _SIZE + code) % top
        drop = None
        if k in dropped:
            options, drop = [(ch, code, math.log(1 - dropped[k]))], math.log(dropped[k])
        else:
            options = [(ch, code, cost), *((c, _CODE[c], _LOOKS) for c in LEET.get(ch, ""))]
            if ch == before and code:
                drop = _REPEAT
        before = ch
        new: dict[int, tuple[float, tuple | None]] = {}
        for state, (score, text) in states.items():
            for out, c, price in options:
                key = state * _SIZE + c
                value, to = score + price + model[key], key % top
                if to not in new or value > new[to][0]:
                    new[to] = (value, (text, out))
            if drop is not None and (state not in new or score + drop > new[state][0]):
                new[state] = (score + drop, text)
        states = new
    score, text = max(((score + model[state * _SIZE], text) for state, (score, text) in states.items()),
                      key=lambda x: x[0])
    if score <= plain + model[at * _SIZE]:
        return "".join(units)
    out = []
    while text is not None:
        text, ch = text
        out.append(ch)
    return "".join(reversed(out))


def restore_token(token: str, logp: np.ndarray) -> str:
    """A token of lower-case text, restored if that is the likelier reading."""
    core = token.strip(".,;:?\"'()[]#*%&<>")
    if _SUSPECT.search(core) and _LETTER.search(core):
        read = decode(core, logp)
        return token if read == core else read
    return token


def restore(text: str, logp: np.ndarray) -> str:
    """The whole text with disguised tokens restored, in lower case, words joined by spaces."""
    return " ".join(restore_token(t, logp) for t in _joined(text.lower(), logp).split())


def _joined(lower: str, logp: np.ndarray) -> str:
    """The text with runs of short groups read as words, where that is the likelier reading."""
    def read(m: re.Match) -> str:
        run = m.group()
        if not _LONE.search(run) or not _LETTER.search(run):
            return run
        parts = _UNITS.findall(run)  # groups and separators in turn
        singles = [0] * len(parts)  # how many single characters follow one another here
        for single, places in groupby(range(0, len(parts), 2), lambda k: len(parts[k]) == 1):
            same = list(places) if single else []
            for k in same:
                singles[k] = len(same)
        units, dropped = [], {}
        for k, part in enumerate(parts):
            if k % 2:
                a, b = sorted((singles[k - 1], singles[k + 1]))
                dropped[len(units)] = _SINGLE if a else _EDGES if b >= 3 else _BESIDE if b else _BETWEEN
                units.append(part)
            else:
                units.extend(part)
        return decode(units, logp, dropped)

    return _RUN.sub(read, lower) if _LONE.search(lower) else lower


def marks_of(token: str, logp: np.ndarray) -> set[str]:
    """Words and beginnings of words in a token."""
    out = set()
    for w in _WORDS.findall(restore_token(token, logp)):
        out.add("=" + w)
        out.update(w[:k] for k in (4, 5, 6) if len(w) >= k)
    return out


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _fit_marks(sample: DataFrame, logp: np.ndarray, features: int) -> dict[str, float]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                marks: set[str] = set()
                for token in set(_joined((text or "").lower(), logp).split()):
                    marks |= marks_of(token, logp)
                found[label].update(marks)
        for label, c in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.string()), pa.array(list(c.values()) if label else [0] * len(c), pa.int64()),
                 pa.array([0] * len(c) if label else list(c.values()), pa.int64())], names=["_mark", "_t", "_o"])

    totals = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return {}
    sums = sample.select("_text", "_label").mapInArrow(count, "_mark string, _t long, _o long").groupBy("_mark").agg(
        F.sum("_t").alias("_t"), F.sum("_o").alias("_o")).where("_t >= 3")
    # log odds of a mark in toxic against other documents, and how sure they are
    odds = F.log((F.col("_t") + 0.5) / (n1 - F.col("_t") + 0.5)) - F.log((F.col("_o") + 0.5) / (n0 - F.col("_o") + 0.5))
    spread = F.sqrt(1 / (F.col("_t") + 0.5) + 1 / (F.col("_o") + 0.5))
    best = (sums.select("_mark", odds.alias("_w"), (odds / spread).alias("_z")).where("_z >= 2.5 and _w >= 2")
            .orderBy(F.desc("_z"), "_mark").limit(features))
    return {r["_mark"]: r["_w"] for r in best.collect()}


def _measure(marks: dict[str, float], logp: np.ndarray):
    cache: dict[str, tuple[float, int]] = {}

    def of_token(token: str) -> tuple[float, int]:
        hits = [marks[m] for m in marks_of(token, logp) if m in marks]
        return (max(hits), 1) if hits else (0.0, 0)

    def of_text(text: str | None) -> tuple[float, float]:
        """Strongest mark, and log of 1 + the number of distinct tokens with one."""
        top, n = 0.0, 0
        for token in set(_joined((text or "").lower(), logp).split()):
            got = cache.get(token)
            if got is None:
                if len(cache) >= _CACHE:
                    cache.clear()
                got = cache[token] = of_token(token)
            if got[1]:
                top, n = max(top, got[0]), n + 1
        return top, math.log1p(n)

    return of_text


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.01, steps: int = 50) -> np.ndarray:
    """Weights of (1, x) by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - l2 * w)
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "toxic", fit_docs: int = FIT_DOCS, features: int = FEATURES) -> DataFrame:
    """(id, held_out, score, predicted).

    Only the text is scored. Null and empty texts have no marks and get the score of no marks.
    Without labels of both classes all scores are 0. Rows are scored one by one, so repeated rows
    agree; null ids are held out only if the empty text's remainder says so (it does). Other
    columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    prepare(spark)
    logp = character_model(docs, text_col)
    named = (labels.select(F.col("doc_id").alias("_label_id"), F.col(label_col).cast("int").alias("_label"))
             .where(F.col("_label_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_label_id")))
             .orderBy(F.xxhash64("_label_id"), "_label_id").limit(fit_docs))
    sample = materialize(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
                         .join(F.broadcast(named), F.col("_id") == F.col("_label_id")).select("_id", "_text", "_label"),
                         "toxic-sample")
    marks = _fit_marks(sample, logp, features)
    measure = _measure(marks, logp)

    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t) for t in texts], columns=["top", "n"])

    weights = None
    if marks:
        rows = (sample.select("_id", "_label", F.pandas_udf(measured, "top double, n double")("_text").alias("m"))
                .select("_id", "_label", "m.*").collect())
        rows.sort(key=lambda r: (r["_id"], r["_label"]))
        weights = fit_logistic(np.array([(r["top"], r["n"]) for r in rows]), np.array([r["_label"] for r in rows]))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if weights is None:
            return pd.Series([0.0] * len(texts))
        m = np.column_stack([np.ones(len(texts)), measured(texts).to_numpy(float).reshape(-1, 2)])
        return pd.Series(1 / (1 + np.exp(-np.clip(m @ weights, -30, 30))))

    out = docs.select(F.col(id_col).alias("_id"), score(F.col(text_col)).alias("_score"))
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"),
                      F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
