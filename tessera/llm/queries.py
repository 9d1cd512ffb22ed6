"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (conversation_repair, line_dedup, merkle, minhash, mixing, quality, sentencepiece_bpe, sharding,
                         suffix_dedup, survival, toxicity, url_filter, word_bpe)
from tessera.llm.common import prepare, read

PIECE_MODEL, WORD_VOCABULARY = "piece_bpe_32k.model", "word_bpe_49k.json"


def piece_model() -> str:
    """Place of the vocabulary file; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path(PIECE_MODEL)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_VOCABULARY)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digest(read(spark, sf_dir, "documents").select("doc_id", "text"), piece_model()).drop("text")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_report(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("copies")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, read(spark, sf_dir, "labels")).drop("text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("score")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digest(read(spark, sf_dir, "documents").select("doc_id", "text"), word_vocabulary()).drop("text")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return survival.audit(docs, read(spark, sf_dir, "labels"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(read(spark, sf_dir, "conversations"))


_OPERATORS = [op1_line_dedup, op2_sentencepiece, op3_fingerprints, op4_mixing, op5_quality, op6_toxicity, op7_near_dedup,
              op8_suffix_dedup, op9_sharding, op10_url_filter, op11_word_bpe, op12_filter_audit, op13_conversation_repair]


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _prepared(fn: Callable) -> Callable:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)
    return run


QUERIES = {f.__name__: _prepared(f) for f in _OPERATORS} | {"pipeline": _prepared(_pipeline)}

ORACLE = {
    "op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, pos, lines[pos] AS line,
         translate(trim(lines[pos], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
seen AS (
  SELECT key, min(doc_id) AS first_id, count(DISTINCT doc_id) AS n FROM lines WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT l.doc_id, l.pos, l.line, coalesce(s.n >= 2 AND s.first_id <> l.doc_id, false) AS gone
  FROM lines l LEFT JOIN seen s ON l.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op12_filter_audit": r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM words GROUP BY text),
said AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
docs AS (
  SELECT x.part, coalesce(s.good, false) AS good, coalesce(s.toxic, false) AS toxic,
         (len(x.w) < 100)::INT + 2 * (100 * len(list_distinct(x.w)) < 80 * len(x.w))::INT
         + 4 * (100 * length(regexp_replace(x.text, '[^A-Z]', '', 'g')) > 10 * length(x.text))::INT
         + 8 * regexp_matches(x.text, '[#$%&*|]')::INT + 16 * (x.doc_id <> f.first_id)::INT AS mask
  FROM words x JOIN firsts f ON x.text = f.text LEFT JOIN said s ON x.doc_id = s.doc_id),
classes AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS t
  FROM docs GROUP BY part, mask),
letters AS (SELECT unnest(range(0, 5)) AS f),
orders AS (
  SELECT a.f AS a, b.f AS b, c.f AS c, d.f AS d, e.f AS e
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT list_aggregate(list_transform([a, b, c, d, e], lambda x: substr('ABCDE', x::INT + 1, 1)), 'string_agg', '') AS filter_order,
         k AS step, [a, b, c, d, e][k] AS f,
         list_sum(list_transform([a, b, c, d, e][1:k - 1], lambda x: (1 << x)::INT)) AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS k)),
counts AS (
  SELECT c.part, s.filter_order, s.step, s.f,
         sum(c.n) FILTER (WHERE c.mask & (coalesce(s.earlier, 0)::INT | (1 << s.f)::INT) = 0) AS kept,
         sum(c.n) FILTER (WHERE c.mask & coalesce(s.earlier, 0)::INT = 0 AND c.mask & (1 << s.f)::INT <> 0) AS removed,
         sum(c.n) FILTER (WHERE c.mask & coalesce(s.earlier, 0)::INT <> 0 AND c.mask & (1 << s.f)::INT <> 0) AS redundant,
         sum(c.n) FILTER (WHERE c.mask = (1 << s.f)::INT) AS unique_fails,
         sum(c.g) FILTER (WHERE c.mask & coalesce(s.earlier, 0)::INT = 0 AND c.mask & (1 << s.f)::INT <> 0) AS good_lost,
         sum(c.t) FILTER (WHERE c.mask & coalesce(s.earlier, 0)::INT = 0 AND c.mask & (1 << s.f)::INT <> 0) AS toxic_lost
  FROM classes c, steps s GROUP BY c.part, s.filter_order, s.step, s.f)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counts
""",
}
