"""12. Filter interaction audit: what each filter removes, in any order of the filters.

A document fails some of the filters; its survival word has a bit for each subset of the filters
(32 bits for five), set if the document passes all filters of the subset. The words of a part and
label are added up bit by bit with carry-save adders: a full adder takes three words of one weight
to a word of the same weight and one of the next, so a million words become twenty, from which the
32 counts are read. Counts of subsets answer every order: what is left after some steps depends on
the set of filters applied and not on their order.

Filters read the text alone, but for ``first``, which a document fails if a smaller id has the same
text. Texts are scanned once; after that a row is an id, a text digest, a mask and the labels.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_trim, materialize, prepare

#: Words that a task holds before they are added up; groups it holds before their counts go out.
WAITING, GROUPS = 1 << 16, 4096


def few_words(text: Column, least: int = 100) -> Column:
    return F.size(_words(text)) < least


def repetitive(text: Column, percent: int = 80) -> Column:
    words = _words(text)
    return F.size(F.array_distinct(words)) * 100 < F.size(words) * percent


def shouting(text: Column, percent: int = 10) -> Column:
    return F.char_length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.char_length(text) * percent


def marked(text: Column) -> Column:
    return text.rlike("[#$%&*|]")


def _words(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space."""
    return F.filter(F.split(ascii_trim(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


#: Filters in the order of their letters; None is the test for an equal text under a smaller id.
FILTERS: dict[str, Callable[[Column], Column] | None] = {
    "A": few_words, "B": repetitive, "C": shouting, "D": marked, "E": None}


def truth_table(n: int) -> list[int]:
    """Survival word by mask of failed filters: bit s is set if no filter of subset s is failed."""
    return [sum(1 << s for s in range(1 << n) if not s & mask) for mask in range(1 << n)]


def survival_words(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): ``part``, ``word`` (its survival word),
    ``good`` and ``toxic`` (a row of ``labels`` says so).

    Null texts are empty, null languages the part ''. A row without an id has no smaller id before
    it than any that is there, so it counts as a copy of every row with an id and the same text, and
    not of another without. Rows that repeat an id count each, and are not copies of one another;
    repeated label rows of an id say yes if one does. Columns other than the named are not read."""
    prepare(docs.sparkSession)
    text = F.col("text")
    mask = F.lit(0)
    for k, test in enumerate(filters.values()):
        if test is not None:
            mask = mask + F.when(test(text), 1 << k).otherwise(0)
    rows = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("part"))
            .select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")))
    rows = materialize(rows, "survival-rows")
    # the first of each text by (digest, id): copies of one text are spread by their ids
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id")).withColumnRenamed("digest", "first_digest")
    said = labels.groupBy(F.col("doc_id").alias("said_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("said_id is not null")
    bit = next((1 << k for k, test in enumerate(filters.values()) if test is None), 0)
    failed = F.col("mask") + F.when(F.col("first_digest").isNull(), bit).otherwise(0)
    table = F.array(*[F.lit(w) for w in truth_table(len(filters))])
    # rows without an id match no label: the digest spreads them
    lone = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(256))).otherwise(F.lit(0))
    rows = (rows.join(firsts, (F.col("digest") == F.col("first_digest")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
            .withColumn("lone", lone)
            .join(said.withColumn("none", F.lit(0)), (F.col("doc_id") == F.col("said_id")) & (F.col("lone") == F.col("none")), "left"))
    return rows.select("part", F.element_at(table, failed + 1).cast("long").alias("word"),
                       F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def add_up(planes: list[np.ndarray]) -> list[np.ndarray]:
    """Carry-save addition: words by weight (planes[k]: weight 2^k) to one word of each weight."""
    out, k = [], 0
    planes = list(planes)
    while k < len(planes):
        words, carries = planes[k], []
        while len(words) > 2:  # full adders: three words to a sum and a carry
            m = len(words) // 3
            a, b, c = words[:m], words[m:2 * m], words[2 * m:3 * m]
            half = a ^ b
            carries.append(a & b | half & c)
            words = np.concatenate([half ^ c, words[3 * m:]])
        if len(words) == 2:  # half adder
            carries.append(words[:1] & words[1:])
            words = words[:1] ^ words[1:]
        out.append(words)
        if carries:
            if k + 1 == len(planes):
                planes.append(np.empty(0, words.dtype))
            planes[k + 1] = np.concatenate([planes[k + 1], *carries])
        k += 1
    return out


def read_off(planes: list[np.ndarray], bits: int) -> list[int]:
    """Count of each bit position from one word of each weight."""
    return [sum(int(w[0] >> np.uint64(s) & np.uint64(1)) << k for k, w in enumerate(planes) if len(w)) for s in range(bits)]


def subset_survivors(words: DataFrame, n_filters: int = len(FILTERS)) -> DataFrame:
    """Per ``part``, ``good`` and ``toxic``: how many rows of :func:`survival_words` survive each
    subset of the filters (columns ``s0`` to ``s31`` for five). A task adds its words up before
    anything is shuffled, so a part that holds most rows sends a few rows."""
    bits = 1 << n_filters
    names = [f"s{s}" for s in range(bits)]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list[np.ndarray]] = {}
        waiting: dict[tuple, list[np.ndarray]] = {}
        n = 0

        def settle() -> None:
            for key, found in waiting.items():
                planes = held.get(key) or [np.empty(0, np.uint64)]
                held[key] = add_up([np.concatenate([planes[0], *found]), *planes[1:]])
            waiting.clear()

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(*key, *read_off(planes, bits)) for key, planes in held.items()],
                                columns=["part", "good", "toxic", *names])

        for batch in batches:
            for key, group in batch.groupby(["part", "good", "toxic"], sort=False):
                waiting.setdefault(key, []).append(group["word"].to_numpy().astype(np.uint64))
            n += len(batch)
            if n >= WAITING or len(waiting) >= GROUPS:
                settle()
                n = 0
                if len(held) >= GROUPS:
                    yield rows()
                    held.clear()
        settle()
        if held:
            yield rows()

    counts = words.select("part", "good", "toxic", "word").mapInPandas(
        count, "part string, good boolean, toxic boolean, " + ", ".join(f"{s} long" for s in names))
    return counts.groupBy("part", "good", "toxic").agg(*[F.sum(s).alias(s) for s in names])


def audit(docs: DataFrame, labels: DataFrame, filters: dict = FILTERS) -> DataFrame:
    """One row per part, order of the filters (``filter_order``) and ``step``: counts of documents
    ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its filter, removed earlier),
    ``unique_fails`` (fail its filter only), ``good_lost`` and ``toxic_lost`` (removed and labelled
    so), and ``shapley`` (what its filter removes, summed over all orders). For the handling of
    nulls and repeated rows see :func:`survival_words`; an empty table gives no rows."""
    letters = list(filters)
    n = len(letters)
    full = (1 << n) - 1
    names = [f"s{s}" for s in range(1 << n)]
    counted = subset_survivors(survival_words(docs, labels, filters), n)

    def survivors(kind: str | None) -> Column:
        return F.array(*[F.sum(F.col(s) if kind is None else F.when(F.col(kind), F.col(s)).otherwise(0)) for s in names])

    parts = counted.groupBy("part").agg(survivors(None).alias("all"), survivors("good").alias("good"),
                                        survivors("toxic").alias("toxic"))
    steps = []
    for order in permutations(range(n)):
        before = 0
        for k, f in enumerate(order):
            steps.append({"filter_order": "".join(letters[i] for i in order), "step": k + 1, "filter": f, "one": 1 << f,
                          "before": before, "after": before | 1 << f})
            before |= 1 << f
    def at(kind: str, subset: Column) -> Column:
        return F.element_at(F.col(kind), subset + 1)

    def shapley(f: int) -> Column:
        total = F.lit(0).cast("long")
        for s in range(1 << n):
            if not s >> f & 1:
                k = s.bit_count()
                lost = F.element_at("all", F.lit(s + 1)) - F.element_at("all", F.lit((s | 1 << f) + 1))
                total = total + lost * F.lit(factorial(k) * factorial(n - 1 - k)).cast("long")
        return total

    fails = at("all", F.lit(0)) - at("all", F.col("one"))
    removed = at("all", F.col("before")) - at("all", F.col("after"))
    parts = parts.withColumn("shapleys", F.array(*[shapley(f) for f in range(n)]))
    # the n * n! steps are a constant: each part is exploded by it, nothing is joined
    table = F.from_json(F.lit(json.dumps(steps)),
                        "array<struct<filter_order: string, step: int, filter: int, one: int, before: int, after: int>>")
    rows = parts.select("*", F.inline(table))
    return rows.select(
        "part", "filter_order", "step", at("all", F.col("after")).alias("kept"), removed.alias("removed"),
        (fails - removed).alias("redundant"),
        (at("all", F.lit(full) - F.col("one")) - at("all", F.lit(full))).alias("unique_fails"),
        (at("good", F.col("before")) - at("good", F.col("after"))).alias("good_lost"),
        (at("toxic", F.col("before")) - at("toxic", F.col("after"))).alias("toxic_lost"),
        F.element_at("shapleys", F.col("filter") + 1).alias("shapley"))
