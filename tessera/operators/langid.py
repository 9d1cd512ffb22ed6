"""Language profiles and the English gate as Spark jobs.

The reference calls a detection library (not available here); we define our own model:
character-trigram naive Bayes, add-one smoothing, uniform prior. Profiles count the whole
lower-cased texts; a document is detected, as in the reference, by its first 5000 code points:

    score(doc, lang) = sum_g k_g * ln(c_lang(g) + 1) - n_doc * ln(N_lang + V)

A document is scored where its row is: an Arrow function looks its trigrams up in the profile, which
every worker holds as sorted arrays, and gives the language and the probability of the target. No
trigram of a document is ever a row. The profile is counted before it is sent; one of more than
``MAX_CELLS`` cells stays a table, and documents' trigram counts are joined with it instead.
Detection failure (no trigram) -> not English.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

LANG_MIN_SCORE = 0.9   # fixed: P(en) threshold of the reference gate
GRAM = 3
#: Cells (trigrams x languages) of a profile that is sent to the workers, 8 bytes each; cells that a
#: worker looks up at once.
MAX_CELLS, CELLS_AT_ONCE = 16_000_000, 1 << 20
#: Trigrams that are counted at once for the profiles.
GRAMS_AT_ONCE = 1 << 22


def trigrams(text: Column, whole: bool = False) -> Column:
    """Overlapping character trigrams of the lower-cased probe prefix, or of the whole text (empty
    when < 3 chars)."""
    # One regex pass: a zero-width match at every position captures the next GRAM characters
    # (indexing a UTF-8 string by code point would make this quadratic in the prefix length).
    t = F.lower(text if whole else T.lang_prefix(text))
    # Not a surrogate: the search also stops inside a character of two UTF-16 units.
    return F.regexp_extract_all(t, F.lit("(?=(\\P{Cs}{%d}))" % GRAM), 1)


def doc_grams(docs: DataFrame, key: str = "doc_id", text_col: str = "text",
              lang_col: str | None = None) -> DataFrame:
    """Trigram counts per document ``(key, [lang,] gram, k)`` — the one explode both the profiles
    and the scoring are derived from."""
    extra = [F.col(lang_col).alias("lang")] if lang_col else []
    g = docs.select(key, *extra, F.explode(trigrams(F.col(text_col))).alias("gram"))
    return g.groupBy(key, *(["lang"] if lang_col else []), "gram").agg(F.count(F.lit(1)).alias("k"))


def profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A10: ``(lang, gram, cnt)`` trigram counts per language, over whole texts. The trigrams of some
    texts at a time are counted as numbers where the texts are; only these counts become rows."""
    g = (labelled.select(F.col(lang_col).alias("lang"), F.lower(F.col(text_col)).alias("text"))
         .mapInArrow(_count_grams, "lang string, gram long, cnt long")
         .groupBy("lang", "gram").agg(F.sum("cnt").cast("bigint").alias("cnt")))
    code = [F.shiftright("gram", 42), F.shiftright("gram", 21).bitwiseAND(F.lit(0x1FFFFF)), F.col("gram").bitwiseAND(F.lit(0x1FFFFF))]
    units = [F.lpad(F.hex(c), 8, "0") for c in code]
    return g.select("lang", F.decode(F.unhex(F.concat(*units)), "UTF-32").alias("gram"), "cnt")


def gram_keys(text: str) -> np.ndarray:
    """The trigrams of a text as numbers, 21 bits a code point."""
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return p[:-2] << 42 | p[1:-1] << 21 | p[2:] if len(p) >= GRAM else p[:0]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def counted(lang: str | None, parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n, pa.int64())],
                                          names=["lang", "gram", "cnt"])

    waiting: dict[str | None, list[np.ndarray]] = {}
    size: Counter = Counter()
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            for keys in _some_keys(text.as_py() or ""):
                waiting.setdefault(lang, []).append(keys)
                size[lang] += len(keys)
                if size.total() >= GRAMS_AT_ONCE:
                    for name in [k for k in waiting if size[k]]:
                        yield counted(name, waiting[name])
                    waiting, size = {}, Counter()
    for name in [k for k in waiting if size[k]]:
        yield counted(name, waiting[name])


def _some_keys(text: str) -> Iterator[np.ndarray]:
    """The trigrams of a text of any length, a bounded number at a time."""
    for k in range(0, max(1, len(text) - GRAM + 1), GRAMS_AT_ONCE):
        yield gram_keys(text[k:k + GRAMS_AT_ONCE + GRAM - 1])


@dataclass
class Profile:
    """A profile as arrays: trigram keys in order and, by trigram and language, ln(c + 1)."""
    langs: list[str]
    keys: np.ndarray
    weights: np.ndarray
    constants: np.ndarray      # by language ln(N + V)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by text and language, and the number of trigrams of each text."""
        out, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        if not self.langs:
            return out, n
        waiting: list[np.ndarray] = []
        first = cells = 0
        for k, t in enumerate(texts):
            waiting.append(gram_keys(t or ""))
            n[k] = len(waiting[-1])
            cells += n[k] * len(self.langs)
            if cells >= CELLS_AT_ONCE or k + 1 == len(texts):
                self._add(out[first:k + 1], n[first:k + 1], np.concatenate(waiting))
                waiting, first, cells = [], k + 1, 0
        return out - n[:, None] * self.constants, n

    def _add(self, out: np.ndarray, n: np.ndarray, grams: np.ndarray) -> None:
        if len(grams):
            at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
            parts = np.where((self.keys[at] == grams)[:, None], self.weights[at], 0.0)
            full = np.flatnonzero(n)
            out[full] = np.add.reduceat(parts, np.concatenate([[0], np.cumsum(n[full])[:-1]]), axis=0)


def gram_key(gram: str) -> int:
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def pack(prof: DataFrame) -> Broadcast | None:
    """The profile for the workers, or None if it has more than ``MAX_CELLS`` cells."""
    prof = prof.where(F.length("gram") == GRAM)
    if prof.select("gram").distinct().count() * prof.select("lang").distinct().count() > MAX_CELLS:
        return None
    rows = prof.groupBy("gram").agg(F.collect_list(F.struct("lang", "cnt")).alias("by")).toArrow()
    counts = [[(e["lang"], e["cnt"]) for e in by] for by in rows["by"].to_pylist()]
    langs = sorted({lang for by in counts for lang, _ in by if lang is not None})
    keys = np.array([gram_key(g) for g in rows["gram"].to_pylist()], np.int64)
    place = {lang: k for k, lang in enumerate(langs)}
    weights = np.zeros((len(keys), len(langs)))
    for k, by in enumerate(counts):
        for lang, n in by:
            if lang is not None:
                weights[k, place[lang]] = n
    constants = np.log(weights.sum(axis=0) + len(keys))
    order = np.argsort(keys)
    return prof.sparkSession.sparkContext.broadcast(Profile(langs, keys[order], np.log1p(weights[order]), constants))


def detect(text: Column, packed: Broadcast, target: str = "en") -> Column:
    """``struct<pred_lang, p>`` of a text, whose first 5000 code points count: the best language
    and the probability of ``target``; both null without a trigram."""
    @F.arrow_udf("pred_lang string, p double")
    def found(texts: pa.Array) -> pa.Array:
        profile = packed.value
        langs = profile.langs
        scores, n = profile.score(texts.to_pylist())
        some = (n > 0) & bool(langs)
        p = np.zeros(len(n))
        best = np.zeros(len(n), np.int64)
        if langs and len(n):
            best = len(langs) - 1 - np.argmax(scores[:, ::-1], axis=1)  # of equal scores the last name
            if target in langs:
                with np.errstate(over="ignore"):
                    p = 1.0 / np.exp(scores - scores[:, [langs.index(target)]]).sum(axis=1)
        names = pa.array([langs[b] if s else None for b, s in zip(best, some)], pa.string())
        return pa.StructArray.from_arrays([names, pa.array(p, pa.float64(), mask=~some)], names=["pred_lang", "p"])

    return found(F.lower(T.lang_prefix(text)))


def scores(docs: DataFrame, prof: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document and language ``(key, lang, score)`` by a join, for profiles too large to be sent.
    A language's constant is folded in after the sums; a document without any trigram of a language
    gets that language's row from the list of languages in its own row."""
    vcount = int(prof.select("gram").distinct().count())
    totals = prof.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.log(F.sum("cnt") + F.lit(vcount)).alias("_c"))
    every = totals.agg(F.collect_list(F.struct("lang", "_c")).alias("_all"))  # one row: the languages
    dg = doc_grams(docs, key, text_col)
    nd = dg.groupBy(key).agg(F.sum("k").alias("n_doc")).withColumn("_one", F.lit(1))
    constant = nd.join(F.broadcast(every.withColumn("_one", F.lit(1))), "_one").select(
        key, (-F.col("n_doc")).alias("n_doc"), F.explode("_all").alias("l")).select(
        key, "l.lang", (F.col("n_doc") * F.col("l._c")).alias("score"))
    seen = dg.join(prof.where(F.col("lang").isNotNull()), "gram").groupBy(key, "lang").agg(
        F.sum(F.col("k") * F.log(F.col("cnt") + 1)).alias("score"))
    return constant.unionByName(seen).groupBy(key, "lang").agg(F.sum("score").alias("score"))


def posterior(sc: DataFrame, key: str = "doc_id", target: str = "en") -> DataFrame:
    """Softmax over languages: ``(key, pred_lang, p)``; no target score -> 0."""
    own = Window.partitionBy(key)   # one row per language
    st = F.max(F.when(F.col("lang") == target, F.col("score"))).over(own)
    best = F.max(F.struct("score", "lang"))
    return sc.withColumn("_st", st).groupBy(key).agg(
        best["lang"].alias("pred_lang"),
        F.coalesce(F.lit(1.0) / F.sum(F.exp(F.col("score") - F.col("_st"))), F.lit(0.0)).alias("p"))


def english(docs: DataFrame, prof: DataFrame, key: str = "doc_id", text_col: str = "text",
            min_score: float = LANG_MIN_SCORE) -> DataFrame:
    """``(key, pred_lang, p_en, is_english)`` for every document (no trigram -> False)."""
    packed = pack(prof)
    if packed is not None:
        out = docs.select(key, detect(F.col(text_col), packed).alias("_f")).select(key, "_f.*")
    else:
        out = docs.select(key).join(posterior(scores(docs, prof, key, text_col), key), key, "left")
    return out.select(key, "pred_lang", F.col("p").alias("p_en"),
                      F.coalesce(F.col("p") >= min_score, F.lit(False)).alias("is_english"))
