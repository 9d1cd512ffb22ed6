"""10. URL filters.

Rules by host and path decide first. What no rule judges is scored: the parts of a host name are
split into words by a Viterbi search over a unigram model, and a multinomial naive Bayes model
scores the words of the host and of the path. The unigram model counts the words of all pages;
naive Bayes learns from the urls that the rules judge.

Neither model is held in one process. The short substrings of the distinct host labels are joined
with the word counts, so a label meets just the words that it can hold, and the token weights are
joined with the tokens of the distinct hosts and of the distinct path shapes (numbers are one
token), never with all pages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, materialize, prepare

#: Fixed: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words up to this length are joined whole; longer ones by their first characters, so that a label
#: gives a fixed number of join keys for each of its characters.
SEED = 20
_CUT_ROWS = 50_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url or one without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("_url"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def segment(label: str, logp: dict[str, float], total: float) -> list[str]:
    """Most likely split of a label into words of any length. A piece that is no known word costs
    ``1 / (total * 10^length)``, so unknown runs stay together when nothing fits. That cost is linear
    in the length: the best start of an unknown piece is kept as one running maximum."""
    lengths = sorted({len(w) for w in logp})
    base, step = -math.log(total), math.log(10.0)
    best: list[tuple[float, int]] = [(0.0, 0)]
    run = (0.0, 0)  # largest best[start] + start * step, with its start
    for end in range(1, len(label) + 1):
        here = (run[0] - end * step + base, run[1])
        for n in lengths:
            if n > end:
                break
            cost = logp.get(label[end - n:end])
            if cost is not None:
                here = max(here, (best[end - n][0] + cost, end - n))
        best.append(here)
        run = max(run, (here[0] + end * step, end))
    out, end = [], len(label)
    while end:
        start = best[end][1]
        out.append(label[start:end])
        end = start
    return out[::-1]


def _segment_groups(total: float):
    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in rows:
            out = []
            for label, words, counts in zip(frame["_label"], frame["_words"], frame["_counts"]):
                known = {w: math.log(n / total) for w, n in zip(words, counts)} if words is not None else {}
                out.append((label, segment(label, known, total)))
            yield pd.DataFrame(out, columns=["_label", "_pieces"])
    return run


def _cuts(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct substrings of up to ``SEED`` characters of each label, under the label's key."""
    for frame in rows:
        keys, cuts = [], []
        for key, label in zip(frame["_lid"], frame["_label"]):
            for n in range(1, min(SEED, len(label)) + 1):
                found = {label[k:k + n] for k in range(len(label) - n + 1)}
                cuts += found
                keys += [key] * len(found)
                if len(cuts) >= _CUT_ROWS:
                    yield pd.DataFrame({"_lid": keys, "_cut": cuts})
                    keys, cuts = [], []
        yield pd.DataFrame({"_lid": keys, "_cut": cuts})


def host_words(labels: DataFrame, words: DataFrame, total: float) -> DataFrame:
    """(_label, _pieces) for distinct labels, given (_word, _n) of the corpus. A word longer than
    ``SEED`` meets the labels that hold its first ``SEED`` characters; the search tells whether they
    hold all of it. Work is linear in a label's length."""
    named = labels.select(F.unhex(F.md5("_label")).alias("_lid"), "_label")
    cuts = named.mapInPandas(_cuts, "_lid binary, _cut string")
    known = (cuts.join(words.withColumn("_cut", F.substring("_word", 1, SEED)), "_cut").groupBy("_lid")
             .agg(F.collect_list("_word").alias("_words"), F.collect_list("_n").alias("_counts")))
    both = named.join(known, "_lid", "left").select("_label", "_words", "_counts")
    return both.mapInPandas(_segment_groups(total), "_label string, _pieces array<string>")


def _tokens(prefix: str, text: Column) -> Column:
    """Distinct runs of letters; runs of digits are one token."""
    plain = F.regexp_replace(F.lower(text), "[0-9]+", " 0 ")
    parts = F.filter(F.split(plain, "[^\\p{L}0]+"), lambda x: x != "")
    return F.transform(parts, lambda x: F.concat(F.lit(prefix), x))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
               rules=RULES, smoothing: float = 1.0) -> DataFrame:
    """(id, host, path, rule, verdict, score): verdict by rule, else ``block`` where the naive Bayes
    log odds for block are above 0 and ``allow`` otherwise (also without any judged url).

    Null urls and urls without ``://`` have empty host and path, match no rule and get the odds of
    the classes alone. Null ids and repeated rows keep their rows. Null html adds no words. Other
    columns are not read. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    prepare(spark)
    host, path = url_parts(F.col("_url"))
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select(
        "_id", host.alias("_host"), path.alias("_path"))
    name, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    shape = F.regexp_replace(F.col("_path"), "[0-9]+", "0")
    base = base.select("_id", "_host", "_path", name.alias("_rule"), verdict.alias("_verdict"), shape.alias("_shape"))
    # unigram model over the words of all pages
    text = F.regexp_replace(F.lower(F.coalesce(F.col(html_col), F.lit(""))), "<[^>]*>", " ")
    words = (pages.select(F.explode(F.split(text, "[^\\p{L}]+")).alias("_word"))
             .where(F.col("_word") != "")
             .groupBy("_word").agg(F.count(F.lit(1)).alias("_n")))
    words = materialize(words, "url-words")
    total = float(words.agg(F.sum("_n")).first()[0] or 1)
    # counts per host, path shape and verdict: all later work is on distinct values
    pairs = materialize(base.groupBy("_host", "_shape", "_verdict").agg(F.count(F.lit(1)).alias("_n")), "url-pairs")
    hosts = pairs.select("_host").distinct()
    parts = hosts.select("_host", F.explode(F.filter(F.split("_host", "[^\\p{L}]+"), lambda x: x != "")).alias("_label"))
    pieces = host_words(parts.select("_label").distinct(), words, total)
    host_tokens = materialize(parts.join(pieces, "_label").select(
        "_host", F.explode(F.transform("_pieces", lambda x: F.concat(F.lit("h:"), x))).alias("_token")), "url-hosts")
    shape_tokens = pairs.select("_shape").distinct().select(
        "_shape", F.explode(_tokens("p:", F.col("_shape"))).alias("_token"))
    # naive Bayes: counts of each token in blocked and in allowed urls
    block = F.sum(F.when(F.col("_verdict") == "block", F.col("_n")).otherwise(0))
    allow = F.sum(F.when(F.col("_verdict") == "allow", F.col("_n")).otherwise(0))
    judged = pairs.where(F.col("_verdict").isNotNull())
    by_host = judged.groupBy("_host").agg(block.alias("_b"), allow.alias("_a"))
    by_shape = judged.groupBy("_shape").agg(block.alias("_b"), allow.alias("_a"))
    counts = (host_tokens.join(by_host, "_host").select("_token", "_b", "_a")
              .unionByName(shape_tokens.join(by_shape, "_shape").select("_token", "_b", "_a"))
              .groupBy("_token").agg(F.sum("_b").alias("_b"), F.sum("_a").alias("_a")))
    counts = materialize(counts, "url-counts")
    size, n_block, n_allow = counts.agg(F.count(F.lit(1)), F.sum("_b"), F.sum("_a")).first()
    docs_b, docs_a = judged.agg(block, allow).first()
    prior = math.log(((docs_b or 0) + smoothing) / ((docs_a or 0) + smoothing))
    norm = math.log(((n_allow or 0) + smoothing * (size or 1)) / ((n_block or 0) + smoothing * (size or 1)))
    weights = counts.select("_token", (F.log((F.col("_b") + smoothing) / (F.col("_a") + smoothing)) + norm).alias("_w"))
    host_score = (host_tokens.join(weights, "_token").groupBy(F.col("_host").alias("_h"))
                  .agg(F.round(F.sum("_w"), 9).alias("_hs")))
    shape_score = (shape_tokens.join(weights, "_token").groupBy(F.col("_shape").alias("_s"))
                   .agg(F.round(F.sum("_w"), 9).alias("_ss")))
    host_score, shape_score = materialize(host_score, "url-host-score"), materialize(shape_score, "url-path-score")
    out = (base.join(host_score, F.col("_host") == F.col("_h"), "left")
           .join(shape_score, F.col("_shape") == F.col("_s"), "left"))
    score = F.coalesce("_hs", F.lit(0.0)) + F.coalesce("_ss", F.lit(0.0)) + F.lit(prior)
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
                      F.col("_rule").alias("rule"),
                      F.coalesce("_verdict", F.when(score > 0, "block").otherwise("allow")).alias("verdict"),
                      score.alias("score"))
