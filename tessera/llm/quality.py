"""5. Quality rules: line sequence labelling.

A linear-chain conditional random field labels each line of a text as content or boilerplate
(Viterbi decoding); a document stays if at least half of its words are in content lines. Fixed
rules on the whole text (too few words, too many repeated five-word windows) reject first.

The field is fitted on a bounded sample of labelled rows: at most ``FIT_DOCS`` documents of each
class, in the order of a hash of their ids, cut into windows of ``WINDOW`` lines over their whole
texts, and at most ``FIT_WINDOWS`` windows of each class, again by a hash. Lines have no labels of
their own: they are hidden labels, decoded under the document's and fitted in turns. Weights are a
few numbers, so they go to the tasks in the function itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, materialize, prepare

FIT_DOCS, FIT_WINDOWS = 1000, 1500
#: Lines of a window, and lines of a training sequence.
WINDOW, CHAIN = 64, 64
SYMBOLS = "#*$%&|<>"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL_WORD = re.compile(r"[^\x20\x09-\x0D]*[#*$%&|<>][^\x20\x09-\x0D]*")
N_FEATURES = 8


def line_features(lines: list[str], words: list[list[str]]) -> np.ndarray:
    """One row per line: bias, symbols by words, words with a symbol, few words, word length,
    sentence end, repeated line, distinct words."""
    out = np.zeros((len(lines), N_FEATURES))
    seen = set()
    for k, (line, w) in enumerate(zip(lines, words)):
        n = len(w) or 1
        symbols = sum(map(line.count, SYMBOLS))
        marked = len(_SYMBOL_WORD.findall(line)) if symbols else 0
        out[k] = (1.0, min(symbols / n, 3.0), marked / n, len(w) < 3, min(sum(map(len, w)) / n / 10, 2.0),
                  line.rstrip().endswith((".", "!", "?", '"')), line in seen, len(set(w)) / n)
        seen.add(line)
    return out


def repeated_words(words: list[str], width: int = 5) -> int:
    """Words that stand in a window of ``width`` words found twice or more. Windows are ranked by
    doubling (pairs, pairs of pairs, then word by word), so equal ranks mean equal windows."""
    if len(words) <= width:
        return 0
    ids: dict[str, int] = {}
    first = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    rank, span = first, 1
    while span < width:
        step = span if 2 * span <= width else 1
        other = rank if step == span else first
        pair = rank[:len(rank) - step] * (int(other.max()) + 1) + other[span:span + len(rank) - step]
        values, rank, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(values) == len(pair):
            return 0
        span += step
    starts = np.flatnonzero(counts[rank] >= 2)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def viterbi(emit: np.ndarray, move: np.ndarray) -> list[int]:
    """Best labels (0 boilerplate, 1 content) for emission scores (lines, 2) and moves (2, 2);
    ties go to content."""
    m00, m01, m10, m11 = move.ravel().tolist()
    rows = emit.tolist()
    a, b = rows[0]
    back = []
    for x, y in rows[1:]:
        from_a, from_b = a + m00 > b + m10, a + m01 > b + m11
        back.append((not from_a, not from_b))
        a, b = (a + m00 if from_a else b + m10) + x, (a + m01 if from_b else b + m11) + y
    at = int(b >= a)
    out = [at]
    for step in reversed(back):
        at = int(step[at])
        out.append(at)
    return out[::-1]


def expectations(emit: np.ndarray, move: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each label of each line, and expected number of each move, for emission scores
    (lines, sequences, 2); ``on`` marks the lines that a sequence has. Sums are scaled at every line."""
    most, n, _ = emit.shape
    e, m = np.exp(emit - emit.max(2, keepdims=True)), np.exp(move - move.max())
    ahead, behind = np.empty((most, n, 2)), np.ones((most, n, 2))
    ahead[0] = e[0] / e[0].sum(1, keepdims=True)
    for t in range(1, most):
        new = (ahead[t - 1] @ m) * e[t]
        ahead[t] = np.where(on[t, :, None], new / new.sum(1, keepdims=True), ahead[t - 1])
    for t in range(most - 2, -1, -1):
        new = (e[t + 1] * behind[t + 1]) @ m.T
        behind[t] = np.where(on[t + 1, :, None], new / new.sum(1, keepdims=True), 1)
    each = ahead * behind
    each *= (on / each.sum(2))[..., None]
    both = ahead[:-1, :, :, None] * m * (e[1:] * behind[1:])[:, :, None, :]
    return each, (both * (on[1:] / both.sum((2, 3)))[..., None, None]).sum((0, 1))


def fit_crf(x: np.ndarray, y: np.ndarray, steps: int = 200, rate: float = 0.3, l2: float = 1e-3,
            start: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (2, features) and moves (2, 2) of greatest likelihood for lines in a row with one label
    each, by gradient steps from ``start``. The row is cut into training sequences of ``CHAIN`` lines."""
    n = -(-len(x) // CHAIN)
    full, gold_y = np.zeros((n * CHAIN, N_FEATURES)), np.zeros(n * CHAIN, int)
    full[:len(x)], gold_y[:len(x)] = x, y
    full, gold_y = full.reshape(n, CHAIN, -1).swapaxes(0, 1), gold_y.reshape(n, CHAIN).T
    on = (np.arange(n * CHAIN) < len(x)).reshape(n, CHAIN).T
    weight, move = (np.zeros((2, N_FEATURES)), np.zeros((2, 2))) if start is None else start
    gold, gold_move = np.zeros((2, N_FEATURES)), np.zeros((2, 2))
    np.add.at(gold, y, x)
    np.add.at(gold_move, (gold_y[:-1][on[1:]], gold_y[1:][on[1:]]), 1)
    speed_w, speed_m = np.zeros_like(weight), np.zeros_like(move)
    for _ in range(steps):
        each, both = expectations(full @ weight.T, move, on)
        grad_w = (gold - each.reshape(-1, 2).T @ full.reshape(-1, N_FEATURES)) / len(x) - l2 * weight
        grad_m = (gold_move - both) / len(x) - l2 * move
        speed_w, speed_m = 0.9 * speed_w + grad_w, 0.9 * speed_m + grad_m
        weight, move = weight + rate * speed_w, move + rate * speed_m
    return weight, move


def hidden_labels(window: np.ndarray, label: int, model) -> np.ndarray:
    """Line labels of a window under its document's label: the decoded ones where at least half of the
    lines agree with the document, else the document's label on all lines."""
    weight, move = model
    path = np.array(viterbi(window @ weight.T, move))
    return path if 2 * (path == label).sum() >= len(path) else np.full(len(window), label)


def fit_lines(windows: list[np.ndarray], labels: list[int], rounds: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """A field over lines from windows of lines whose documents' labels are known.

    Line labels are hidden. They start as the document's; each further round decodes them under that
    label and fits again from where the last fit ended. The windows are set in a row, so that the field
    sees labels change, as they do where boilerplate meets content."""
    x = np.concatenate(windows)
    model = fit_crf(x, np.repeat(labels, [len(w) for w in windows]))
    for _ in range(rounds):
        y = np.concatenate([hidden_labels(w, v, model) for w, v in zip(windows, labels)])
        model = fit_crf(x, y, steps=60, start=model)
    return model


def _split(text: str | None) -> tuple[list[str], list[list[str]]]:
    lines = (text or "").split("\n")
    return lines, [_WORD.findall(x) for x in lines]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS):
    """The model, or None if the labels lack one of the classes (then every line is content)."""
    named = labels.select(F.col("doc_id").alias("_label_id"), F.col(label_col).cast("int").alias("_label"))
    picked = None
    for label in (0, 1):
        some = (named.where((F.col("_label") == label) & F.col("_label_id").isNotNull())
                .orderBy(F.xxhash64("_label_id"), "_label_id").limit(fit_docs))
        picked = some if picked is None else picked.unionByName(some)

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for key, label, text in zip(frame["_id"], frame["_label"], frame["_text"]):
                x = line_features(*_split(text))
                at = range(0, len(x), WINDOW)
                yield pd.DataFrame({"_id": [str(key)] * len(at), "_label": [label] * len(at), "_window": list(at),
                                    "_x": [x[k:k + WINDOW].ravel().tolist() for k in at]})

    every = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
             .join(F.broadcast(picked), F.col("_id") == F.col("_label_id")).select("_id", "_label", "_text")
             .mapInPandas(windows, "_id string, _label int, _window long, _x array<double>"))
    every = materialize(every, "quality-windows")
    rows = []
    for label in (0, 1):
        rows += (every.where(F.col("_label") == label)
                 .orderBy(F.xxhash64("_id", "_window"), "_id", "_window", "_x").limit(fit_windows).collect())
    if {r["_label"] for r in rows} != {0, 1}:
        return None
    # windows of both classes meet in the order of a hash
    rows.sort(key=lambda r: (zlib.crc32(f"{r['_id']}:{r['_window']}".encode()), r["_id"], r["_window"], r["_label"],
                             r["_x"]))
    return fit_lines([np.array(r["_x"]).reshape(-1, N_FEATURES) for r in rows], [r["_label"] for r in rows])


def judge_text(text: str | None, model) -> tuple:
    lines, words = _split(text)
    flat = [w for line in words for w in line]
    seen: set[str] = set()
    dup = 0
    for line, w in zip(lines, words):
        if w:
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(flat)
    failed = len(flat) < 10 or 100 * repeat > 20 * len(flat)
    share = 1.0
    if model is not None and flat:
        weight, move = model
        path = viterbi(line_features(lines, words) @ weight.T, move)
        share = sum(len(w) for w, c in zip(words, path) if c) / len(flat)
    return (len(flat), sum(map(len, flat)), sum(map((text or "").count, SYMBOLS)), dup, repeat, failed,
            not failed and share >= 0.5, share)


_COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
            "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "content_share": "double"}


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus the counts, ``base_failed``, ``kept`` and ``content_share``
    (input columns of those names are replaced).

    Null and empty texts have no words and fail the base rules. Rows are judged one by one, so
    repeated rows and null ids get the same verdict as others. An empty table gives an empty
    table. Without labels of both classes only the base rules judge.
    """
    prepare(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col)

    @F.pandas_udf(", ".join(f"{k} {v}" for k, v in _COLUMNS.items()))
    def verdict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge_text(t, model) for t in texts], columns=list(_COLUMNS))

    rest = [c for c in docs.columns if c.lower() not in _COLUMNS]
    v = free_name("_v", docs.columns)
    return docs.select(*rest, verdict(F.col(text_col)).alias(v)).select(*rest, f"{v}.*")
