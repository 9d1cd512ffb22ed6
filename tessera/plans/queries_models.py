"""Queries for the trained vocabulary (BPE) and the language gate, plus the shard report (L3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import bytelevel as BL
from tessera.functions import text as T
from tessera.operators import bpe, dedupe, langid, shards
from tessera.operators.materialize import materialize
from tessera.plans import corpus
from tessera.plans import sql as S
from tessera.plans.queries import _CLEAN_DOCS, GATE_SQL, TRAIN_FRAC, gate_sql, lang_profile, query, tri_sql
from tessera.plans.queries_windows import BIGRAM_CTX, EVAL_BATCH, EVAL_MAX_BATCHES, _bigram_sql, split_all
from tessera.session import shared_dir
from tessera.sources import artifacts, tables

# ---------------------------------------------------------------------------
# Fixed query parameters
# ---------------------------------------------------------------------------
VOCAB_SIZE = 340          # 260 byte-level base tokens + 80 merges; a parameter of bpe.train
FULL_VOCAB_SIZE = 32_000
MIN_FREQUENCY = 2
ROUNDTRIP_SAMPLES = 1000


def _model(spark, d):
    return corpus.bpe_model(spark, d, VOCAB_SIZE, MIN_FREQUENCY)


# --- A6 S15 U4 ----------------------------------------------------------------------------------------
# One merge a recursion step. Symbols carry a space on either side, so replace() merges left to right.
# Rows: w = word with its symbols, v = vocabulary, m = the merge of the step.
_BASE_SQL = ", ".join(f"({i}, {S.q(t)})" for i, t in
                      enumerate([*BL.SPECIAL_TOKENS, *sorted(BL.BYTE_CHARS, key=ord)]))
def bpe_sql(before: str = "", more_words: str = "") -> str:
    """Training, one merge a step; ``more_words`` are merged along without being counted."""
    return f"""
WITH RECURSIVE {before}c AS ({_CLEAN_DOCS}),
k AS (SELECT doc_id, text FROM c WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY sha1(text) ORDER BY doc_id) = 1),
wc AS (SELECT word, sum(n)::BIGINT AS cnt
       FROM (SELECT unnest({S.words('text')}) AS word, 1 AS n FROM k{more_words}) GROUP BY word),
base(id, token) AS (VALUES {_BASE_SQL}),
st(it, kind, word, cnt, sy, id) AS (
  (SELECT 0, 'w', word, cnt,
          list_aggregate(list_transform({S.byte_chars('word')}, lambda x: ' ' || x || ' '), 'string_agg', ''),
          NULL::INTEGER FROM wc
   UNION ALL SELECT 0, 'v', token, NULL, NULL, id FROM base)
  UNION ALL
  (WITH s AS (SELECT cnt, string_split(trim(sy), '  ') AS a FROM st WHERE kind = 'w' AND contains(sy, '  ')),
   p AS (SELECT a[i] AS l, a[i + 1] AS r, sum(cnt) AS n
         FROM (SELECT cnt, a, unnest(range(1, len(a))) AS i FROM s) GROUP BY ALL),
   v AS (SELECT word, id FROM st WHERE kind = 'v'),
   best AS (SELECT l, r FROM p JOIN v vl ON vl.word = l JOIN v vr ON vr.word = r
            WHERE n >= {MIN_FREQUENCY} AND (SELECT count(*) FROM v) < {VOCAB_SIZE}
            ORDER BY n DESC, vl.id, vr.id LIMIT 1)
   SELECT st.it + 1, kind, word, cnt,
          CASE WHEN kind = 'w' THEN replace(sy, ' ' || l || '  ' || r || ' ', ' ' || l || r || ' ') END, id
   FROM st, best WHERE kind IN ('w', 'v')
   UNION ALL SELECT (SELECT max(it) FROM st) + 1, 'v', l || r, NULL, NULL, (SELECT max(id) + 1 FROM v)::INTEGER
   FROM best WHERE l || r NOT IN (SELECT word FROM v)
   UNION ALL SELECT (SELECT max(it) FROM st) + 1, 'm', l, NULL, r, NULL FROM best)),
voc AS (SELECT word AS token, id FROM st WHERE kind = 'v' AND it = (SELECT max(it) FROM st)),
fin AS (SELECT word, string_split(trim(sy), '  ') AS sy FROM st WHERE kind = 'w' AND it = (SELECT max(it) FROM st)),
wt AS (SELECT word, count(*) AS n, sum(id) AS sum_ids, any_value(bytes) AS bytes
       FROM (SELECT word, array_to_string(sy, '') AS bytes, unnest(sy) AS token FROM fin) JOIN voc USING (token)
       GROUP BY word),
enc AS (SELECT doc_id, source, coalesce(sum(n), 0) + 1 AS n_tokens, coalesce(sum(sum_ids), 0) + {BL.EOS_ID} AS sum_ids
        FROM (SELECT doc_id, source, unnest({S.words('text')}) AS word FROM c WHERE text <> '') JOIN wt USING (word)
        GROUP BY doc_id, source)"""


_BPE_SQL = bpe_sql()


@query("bpe_merges", _BPE_SQL + """
SELECT (it - 1)::INTEGER AS rank, word AS "left", sy AS "right", voc.id
FROM st JOIN voc ON voc.token = word || sy WHERE kind = 'm'""")
def q_bpe_merges(spark, d):
    return _model(spark, d).merges.select("rank", "left", "right", "id")


# the size that the reference trains; one merge a step is too slow in SQL, so there is none: the test
# compares all merges with those of the tokenizers library
@query("bpe_merges_32k")
def q_bpe_merges_32k(spark, d):
    return corpus.bpe_model(spark, d, FULL_VOCAB_SIZE, MIN_FREQUENCY).merges.select("rank", "left", "right", "id")


@query("bpe_vocab", _BPE_SQL + "\nSELECT token, id FROM voc")
def q_bpe_vocab(spark, d):
    path = shared_dir(spark, "vocab")
    artifacts.save_vocab(_model(spark, d), path)
    return artifacts.load_vocab(spark, path)[0]


# --- P8 -----------------------------------------------------------------------------------------------
def _clean_docs(spark, d):
    docs = tables.documents(spark, d, "doc_id", "source", "text")
    return docs.where(T.has_content("text")).select("doc_id", "source", T.canonical_text("text").alias("text"))


@query("bpe_encode_lengths", _BPE_SQL + """
SELECT doc_id, n_tokens::BIGINT AS n_tokens, sum_ids::BIGINT AS sum_ids FROM enc""")
def q_bpe_encode_lengths(spark, d):
    # per-document totals from word-level pieces (partial aggregates): no document's id list is built
    m = _model(spark, d)
    c = _clean_docs(spark, d).select(F.col("source").alias("shard"), F.col("doc_id").alias("ord"), "text")
    p = bpe.encode_pieces(c, m)
    return p.groupBy(F.col("ord").alias("doc_id")).agg(
        F.sum(F.size("ids")).cast("bigint").alias("n_tokens"),
        F.sum(F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x)).cast("bigint").alias("sum_ids"))


# --- A7 W9 P9: a line decodes exactly when its tokens spell its bytes --------------------------------------
@query("bpe_roundtrip", _BPE_SQL + f""",
l AS (SELECT doc_id, text FROM k ORDER BY doc_id LIMIT {ROUNDTRIP_SAMPLES}),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
      FROM (SELECT doc_id, {S.words('text')} AS ws FROM l)),
dec AS (SELECT doc_id, string_agg(bytes, '' ORDER BY pos) AS bytes FROM w JOIN wt USING (word) GROUP BY doc_id)
SELECT count(*)::BIGINT AS roundtrip_checked,
       count(*) FILTER (WHERE dec.bytes = array_to_string({S.byte_chars('l.text')}, ''))::BIGINT AS roundtrip_exact,
       roundtrip_exact / roundtrip_checked AS roundtrip_rate FROM l LEFT JOIN dec USING (doc_id)""")
def q_bpe_roundtrip(spark, d):
    m = _model(spark, d)
    c = dedupe.first_lines(tables.documents(spark, d, "doc_id", "text", "ord"), ROUNDTRIP_SAMPLES)
    return bpe.roundtrip(c.select("ord", "text"), m, ROUNDTRIP_SAMPLES)


# --- L2 S14 A8 ----------------------------------------------------------------------------------------
@query("bpe_shard_meta", _BPE_SQL + """
SELECT source AS shard, sum(n_tokens)::BIGINT AS tokens, 'int32' AS dtype FROM enc GROUP BY source""")
def q_bpe_shard_meta(spark, d):
    docs = tables.documents(spark, d, "doc_id", "source", "text")
    return shards.shard_meta(corpus.tokenize_sources(docs, _model(spark, d)))


# --- L1 F6: the whole build, manifest after every shard's split -----------------------------------------
@query("corpus_build", _BPE_SQL + f""",
n AS (SELECT source AS shard, sum(n_tokens)::BIGINT AS n FROM enc GROUP BY source),
t AS (SELECT shard, n, least(greatest(1, floor(n * {TRAIN_FRAC})::BIGINT), n - 1) AS train FROM n)
SELECT shard, train AS tokens, 'int32' AS dtype FROM t
UNION ALL SELECT coalesce(shard, '{shards.NULL_SHARD}') || '_val', n - train, 'int32' FROM t""")
def q_corpus_build(spark, d):
    built = corpus.build(spark, d, VOCAB_SIZE, split_shards=None, train_frac=TRAIN_FRAC,
                         steps=("clean_dedupe", "bpe", "tokenize", "split", "verify"))
    return built.tables["shard_meta"]


# --- A10 F3 -------------------------------------------------------------------------------------------
@query("lang_profiles", tri_sql() + "\nSELECT lang, gram, cnt::BIGINT AS cnt FROM prof")
def q_lang_profiles(spark, d):
    return langid.profiles(tables.table(spark, d, "documents", "lang", "text"))


def _gate(spark, d):
    docs = tables.table(spark, d, "documents", "doc_id", "text")
    return langid.english(docs, lang_profile(spark, d))


@query("english_gate", GATE_SQL + "\nSELECT doc_id, pred_lang, round(p_en, 6) AS p_en, is_english FROM out")
def q_english_gate(spark, d):
    return _gate(spark, d).select("doc_id", "pred_lang", F.round("p_en", 6).alias("p_en"), "is_english")


# profiles of the documents with an even id, scored on those with an odd one
@query("lang_accuracy", gate_sql("coalesce(doc_id % 2 = 0, false)") + """
SELECT documents.lang, count(*)::BIGINT AS docs, count(*) FILTER (WHERE out.pred_lang = documents.lang)::BIGINT AS correct,
       count(*) FILTER (WHERE out.is_english)::BIGINT AS gated_english
FROM documents JOIN out USING (doc_id) WHERE doc_id % 2 <> 0 GROUP BY documents.lang""")
def q_lang_accuracy(spark, d):
    docs = tables.table(spark, d, "documents", "doc_id", "lang", "text")
    prof = lang_profile(spark, d, F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False)))
    held = docs.where(F.col("doc_id") % 2 != 0)
    j = held.select("doc_id", "lang").join(langid.english(held, prof), "doc_id")
    return j.groupBy("lang").agg(F.count(F.lit(1)).cast("bigint").alias("docs"),
                                 F.count(F.when(F.col("pred_lang") == F.col("lang"), 1)).cast("bigint").alias("correct"),
                                 F.count(F.when(F.col("is_english"), 1)).cast("bigint").alias("gated_english"))


# --- L3 -----------------------------------------------------------------------------------------------
def _usage_sql() -> str:
    from tessera.plans.queries_windows import _TOK_SQL
    return _TOK_SQL + f""",
sp AS (SELECT shard, CASE WHEN n - greatest(1, floor(n * {TRAIN_FRAC})::BIGINT) < 1 THEN n - 1
                          ELSE greatest(1, floor(n * {TRAIN_FRAC})::BIGINT) END AS k FROM m),
u AS (SELECT DISTINCT shard, tok.id FROM tok JOIN sp USING (shard) WHERE tok.pos >= sp.k)
SELECT shard || '_val' AS shard, count(*)::BIGINT AS unique_ids,
       round(count(*) / {BL.BASE_VOCAB_SIZE} * 100, 2) AS coverage_pct FROM u GROUP BY shard"""


@query("shard_report", f"""
SELECT c.shard, c.val_loss AS capped_loss, c.val_tokens AS capped_tokens, f.val_loss AS full_loss,
       f.val_tokens AS full_tokens, u.unique_ids, u.coverage_pct
FROM ({_bigram_sql(EVAL_MAX_BATCHES)}) c JOIN ({_bigram_sql(None)}) f USING (shard) JOIN ({_usage_sql()}) u USING (shard)""")
def q_shard_report(spark, d):
    train, val = split_all(spark, d)
    rep = corpus.diagnose(train, val, BIGRAM_CTX, BL.BASE_VOCAB_SIZE, EVAL_BATCH, EVAL_MAX_BATCHES, suffix="_val")
    return rep.select("shard", F.round("capped.val_loss", 6).alias("capped_loss"),
                      F.col("capped.val_tokens").alias("capped_tokens"),
                      F.round("full.val_loss", 6).alias("full_loss"), F.col("full.val_tokens").alias("full_tokens"),
                      F.col("vocab_usage.unique_ids").alias("unique_ids"),
                      F.col("vocab_usage.coverage_pct").alias("coverage_pct"))

