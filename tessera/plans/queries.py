"""Query registry: one Spark job per inventory item, each with its DuckDB oracle where SQL can say it.

Every query reads the given tables in full. Parameters are fixed here, never tuned to the data
at hand; data-dependent parameters (like a cap of half the tokens) are computed by the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bytelevel as BL
from tessera.functions import text as T
from tessera.operators import capping, dedupe, filters, langid, shards
from tessera.operators.materialize import materialize
from tessera.operators.order import with_ordinal
from tessera.plans import sql as S
from tessera.sources import tables

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


# ---------------------------------------------------------------------------
# Fixed query parameters
# ---------------------------------------------------------------------------
CAP_BATCH_DOCS = 50
CHUNK = shards.CHUNK_SIZE
TRAIN_FRAC = 0.95

_CLEAN_DOCS = f"""
  SELECT doc_id, source, lang, {S.canonical('text')} AS text FROM documents"""


# --- P1 F1 P3 D1: exact dedupe, first occurrence survives -------------------------------
def _cleaned(spark, d):
    docs = tables.documents(spark, d, "doc_id", "source", "lang", "text", "ord")
    return dedupe.clean(docs)


@query("clean_dedupe", f"""
WITH c AS ({_CLEAN_DOCS}), k AS (SELECT *, sha1(text) AS sha1 FROM c WHERE text <> '')
SELECT doc_id, source, sha1, text FROM k
QUALIFY row_number() OVER (PARTITION BY sha1 ORDER BY doc_id) = 1""")
def q_clean_dedupe(spark, d):
    return dedupe.first_per_digest(_cleaned(spark, d)).select("doc_id", "source", "sha1", "text")


# --- D2 ------------------------------------------------------------------------------------
@query("dedupe_stats", f"""
WITH c AS ({_CLEAN_DOCS}),
k AS (SELECT text, CASE WHEN text <> '' THEN sha1(text) END AS sha1 FROM c),
g AS (SELECT sha1, count(*) AS n, octet_length(encode(first(text))) AS b FROM k GROUP BY sha1)
SELECT sum(n)::BIGINT AS input_lines,
       coalesce(sum(n) FILTER (WHERE sha1 IS NULL), 0)::BIGINT AS empty_dropped,
       (coalesce(sum(n) FILTER (WHERE sha1 IS NOT NULL), 0) - count(sha1))::BIGINT AS duplicates_dropped,
       count(sha1)::BIGINT AS kept,
       CASE WHEN coalesce(sum(n) FILTER (WHERE sha1 IS NOT NULL), 0) > 0
            THEN (sum(n) FILTER (WHERE sha1 IS NOT NULL) - count(sha1))::DOUBLE
                 / (sum(n) FILTER (WHERE sha1 IS NOT NULL))::DOUBLE ELSE 0.0 END AS dedupe_ratio,
       coalesce(sum(b + 1) FILTER (WHERE sha1 IS NOT NULL), 0)::BIGINT AS bytes
FROM g""")
def q_dedupe_stats(spark, d):
    return dedupe.dedupe_stats(_cleaned(spark, d))


# --- P2 A1 S4: ingest normalisation and manifest counters ---------------------------------
@query("normalize_manifest", f"""
WITH n AS (SELECT {S.normalize_doc('text')} AS line FROM documents)
SELECT count(*) FILTER (WHERE line <> '')::BIGINT AS lines,
       count(*) FILTER (WHERE line = '')::BIGINT AS empty_skipped,
       coalesce(sum(octet_length(encode(line)) + 1) FILTER (WHERE line <> ''), 0)::BIGINT AS bytes
FROM n""")
def q_normalize_manifest(spark, d):
    from tessera.sources.textfiles import manifest_counts
    docs = tables.table(spark, d, "documents", "text")
    return manifest_counts(docs.select(T.normalize_doc("text").alias("line")))


# --- F2 -------------------------------------------------------------------------------------
@query("length_filter", f"""
SELECT doc_id, length(text)::BIGINT AS n_chars FROM documents
WHERE text IS NOT NULL AND length(text) BETWEEN {T.MIN_CHARS} AND {T.MAX_CHARS}""")
def q_length_filter(spark, d):
    docs = tables.table(spark, d, "documents", "doc_id", "text")
    return docs.where(filters.length_ok("text")).select(
        "doc_id", T.char_len("text").cast("bigint").alias("n_chars"))


# --- F3: SQL of the language gate; ``fitted`` says which documents the profiles count -----------
def tri_sql(fitted: str = "true") -> str:
    return f"""
WITH w AS (SELECT lang, lower(text) AS t FROM documents WHERE {fitted}),
wg AS (SELECT lang, substr(t, i::BIGINT, 3) AS gram FROM w, range(1, length(t) - 1) r(i) WHERE length(t) >= 3),
d AS (SELECT doc_id, lang, lower(substr(text, 1, 5000)) AS t FROM documents),
g AS (SELECT doc_id, lang, substr(t, i::BIGINT, 3) AS gram FROM d, range(1, length(t) - 1) r(i) WHERE length(t) >= 3),
prof AS (SELECT lang, gram, count(*) AS cnt FROM wg GROUP BY ALL)"""


def gate_sql(fitted: str = "true") -> str:
    return tri_sql(fitted) + f""",
v AS (SELECT count(DISTINCT gram) AS v FROM prof),
nl AS (SELECT lang, sum(cnt) AS n FROM prof GROUP BY lang),
dg AS (SELECT doc_id, gram, count(*) AS k FROM g GROUP BY ALL),
nd AS (SELECT doc_id, sum(k) AS n_doc FROM dg GROUP BY doc_id),
sn AS (SELECT dg.doc_id, prof.lang, sum(dg.k * ln(prof.cnt + 1)) AS s FROM dg JOIN prof USING (gram) GROUP BY ALL),
sc AS (SELECT nd.doc_id, nl.lang, coalesce(sn.s, 0) - nd.n_doc * ln(nl.n + v.v) AS score
       FROM nd JOIN nl ON true JOIN v ON true LEFT JOIN sn ON sn.doc_id = nd.doc_id AND sn.lang = nl.lang),
po AS (SELECT doc_id, arg_max(lang, score) AS pred_lang,
              max(score) FILTER (WHERE lang = 'en') AS s_en FROM sc GROUP BY doc_id),
pe AS (SELECT sc.doc_id, 1.0 / sum(exp(sc.score - po.s_en)) AS p_en FROM sc JOIN po USING (doc_id) GROUP BY sc.doc_id),
out AS (SELECT d.doc_id, po.pred_lang, pe.p_en, coalesce(pe.p_en >= {langid.LANG_MIN_SCORE}, false) AS is_english
        FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN po USING (doc_id) LEFT JOIN pe USING (doc_id))"""


GATE_SQL = gate_sql()


def lang_profile(spark, d, fitted=None):
    docs = tables.table(spark, d, "documents", "doc_id", "lang", "text")
    return materialize(langid.profiles(docs if fitted is None else docs.where(fitted)), "lang_profiles")


_REASON_SQL = f"""CASE WHEN text IS NULL OR text = '' THEN 'empty'
  WHEN length(text) < {T.MIN_CHARS} THEN 'too_short'
  WHEN length(text) > {T.MAX_CHARS} THEN 'too_long'
  WHEN NOT coalesce(is_english, false) THEN 'not_english' ELSE 'kept' END"""
GATED_SQL = GATE_SQL + f""",
gated AS (SELECT doc_id, text, {_REASON_SQL} AS reason FROM documents LEFT JOIN out USING (doc_id))"""


def reason_column(packed):
    """F4 with the detected language (F3): only texts that pass the length gate are scored."""
    scored = F.when(filters.length_ok("text"), F.col("text"))
    return filters.drop_reason("text", langid.detect(scored, packed)["p"] >= langid.LANG_MIN_SCORE)


def _gated(spark, d):
    """``(doc_id, reason, n_tokens)`` of every document, from one pass over the texts."""
    docs = tables.table(spark, d, "documents", "doc_id", "text")
    packed = langid.pack(lang_profile(spark, d))
    return materialize(docs.select("doc_id", reason_column(packed).alias("reason"),
                                   (F.octet_length("text") + 1).cast("bigint").alias("n_tokens")), "gated")


# --- F4 ------------------------------------------------------------------------------------
@query("drop_reasons", GATED_SQL + "\nSELECT reason, count(*)::BIGINT AS n FROM gated GROUP BY 1")
def q_drop_reasons(spark, d):
    return _gated(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# --- W1 ---------------------------------------------------------------------------------------
@query("doc_order", GATED_SQL + """
SELECT doc_id, row_number() OVER (ORDER BY doc_id)::BIGINT AS ord FROM gated WHERE reason = 'kept'""")
def q_doc_order(spark, d):
    return with_ordinal(_gated(spark, d).where("reason = 'kept'").select("doc_id"), ["doc_id"], "ord")


# --- W2 A2: token-capped prefix (1 token per UTF-8 byte + EOS, raw text, cap = half) -------
def cap_sql(gated: str, n_tokens: str) -> str:
    return gated + f""",
s AS (SELECT doc_id, reason = 'kept' AS pass, ({n_tokens})::BIGINT AS n_tokens FROM gated),
kd AS (SELECT doc_id, n_tokens,
              row_number() OVER (ORDER BY doc_id) AS kept_rank,
              sum(n_tokens) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
       FROM s WHERE pass),
p AS (SELECT (sum(n_tokens) // 2)::BIGINT AS cap, count(*) AS k FROM kd),
stop_at AS (SELECT min(kept_rank) AS r FROM kd, p WHERE cum >= cap),
lb AS (SELECT p.cap, p.k, (stop_at.r - 1) // {CAP_BATCH_DOCS} AS last_batch FROM p, stop_at),
docs AS (
  SELECT kd.doc_id, kd.kept_rank::BIGINT AS kept_rank, ((kd.kept_rank - 1) // {CAP_BATCH_DOCS})::BIGINT AS batch,
         kd.n_tokens, greatest(0, least(kd.n_tokens, lb.cap - (kd.cum - kd.n_tokens)))::BIGINT AS tokens_kept
  FROM kd, lb WHERE lb.last_batch IS NULL OR (kd.kept_rank - 1) // {CAP_BATCH_DOCS} <= lb.last_batch)"""


_CAP_SQL = cap_sql(GATED_SQL, "octet_length(encode(text)) + 1")


def _cap(spark, d):
    docs = _gated(spark, d)
    passed = F.col("reason") == "kept"
    total = docs.where(passed).agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    return capping.capped_prefix(docs, "doc_id", passed, F.col("n_tokens"), max(1, int(total) // 2), CAP_BATCH_DOCS)


@query("token_cap_prefix", _CAP_SQL + "\nSELECT * FROM docs")
def q_token_cap_prefix(spark, d):
    return _cap(spark, d).docs.select("doc_id", "kept_rank", "batch", "n_tokens", "tokens_kept")


CAP_STATS_SQL = f""",
kept_docs AS (SELECT count(*) AS docs_kept, coalesce(sum(tokens_kept), 0) AS tokens FROM docs),
star AS (SELECT max(kd.doc_id) AS star_ord FROM kd, kept_docs WHERE kd.kept_rank <= kept_docs.docs_kept),
brk AS (SELECT (lb.last_batch IS NOT NULL AND (lb.last_batch + 1) * {CAP_BATCH_DOCS} <= lb.k) AS broke FROM lb),
seen AS (SELECT count(*) FILTER (WHERE NOT brk.broke OR s.doc_id <= star.star_ord) AS docs_seen
         FROM s, brk, star)
SELECT seen.docs_seen::BIGINT AS docs_seen, kept_docs.docs_kept::BIGINT AS docs_kept,
       (seen.docs_seen - kept_docs.docs_kept)::BIGINT AS docs_dropped,
       kept_docs.tokens::BIGINT AS tokens, p.cap::BIGINT AS token_cap,
       (kept_docs.tokens >= p.cap) AS hit_cap
FROM seen, kept_docs, p"""


@query("cap_stats", _CAP_SQL + CAP_STATS_SQL)
def q_cap_stats(spark, d):
    return _cap(spark, d).stats


# --- P6 A4 A5: pre-token and symbol-pair frequencies ----------------------------------------
_WORDS_SQL = f"""
WITH c AS ({_CLEAN_DOCS}),
w AS (SELECT unnest({S.words('text')}) AS word FROM c WHERE text <> '')"""


def _word_counts(spark, d):
    from tessera.operators import bpe
    docs = tables.documents(spark, d, "doc_id", "text")
    return bpe.word_counts(docs.select(T.canonical_text("text").alias("text")))


@query("word_counts", _WORDS_SQL + "\nSELECT word, count(*)::BIGINT AS cnt FROM w GROUP BY word")
def q_word_counts(spark, d):
    return _word_counts(spark, d).select("word", "cnt")


@query("pair_counts", _WORDS_SQL + f""",
wc AS (SELECT word, count(*) AS cnt FROM w GROUP BY word),
s AS (SELECT cnt, {S.byte_chars('word')} AS sy FROM wc),
p AS (SELECT cnt, unnest(list_transform(range(1, len(sy)), lambda i: {{'l': sy[i], 'r': sy[i + 1]}})) AS pr
      FROM s WHERE len(sy) >= 2)
SELECT pr.l AS "left", pr.r AS "right", sum(cnt)::BIGINT AS cnt FROM p GROUP BY 1, 2""")
def q_pair_counts(spark, d):
    from tessera.operators import bpe
    w = bpe.symbol_words(_word_counts(spark, d))
    return bpe.pair_counts(w).select("left", "right", "cnt")


# --- P7 P10: byte-level base ids with EOS -----------------------------------------------------
_BYTE_DOCS_SQL = f"""
WITH c AS ({_CLEAN_DOCS}),
b AS (SELECT doc_id, lang AS shard, list_append({S.base_ids('text')}, {BL.EOS_ID}) AS ids
      FROM c WHERE text <> '')"""


def _byte_docs(spark, d):
    docs = tables.documents(spark, d, "doc_id", "lang", "text")
    c = docs.where(T.has_content("text")).select(
        "doc_id", F.col("lang").alias("shard"), T.canonical_text("text").alias("text"))
    return c.select("doc_id", "shard", F.col("doc_id").alias("ord"),
                    BL.with_eos(BL.base_ids("text")).alias("ids"))


@query("byte_encode", _BYTE_DOCS_SQL + """
SELECT doc_id, len(ids)::BIGINT AS n_tokens, array_to_string(ids, ',') AS ids_csv FROM b""")
def q_byte_encode(spark, d):
    b = _byte_docs(spark, d)
    return b.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                    F.array_join("ids", ",").alias("ids_csv"))


# --- W3 A8: packing into shards ---------------------------------------------------------------
_PACK_SQL = _BYTE_DOCS_SQL + """,
pk AS (SELECT shard, doc_id, len(ids)::BIGINT AS n_tokens,
              (sum(len(ids)) OVER (PARTITION BY shard ORDER BY doc_id
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len(ids))::BIGINT AS start
       FROM b)"""


@query("pack_offsets", _PACK_SQL + "\nSELECT shard, doc_id, start, n_tokens FROM pk")
def q_pack_offsets(spark, d):
    # per-document offsets need only each document's token count (bytes + EOS), not its ids
    from tessera.operators.order import with_running_sums
    docs = tables.documents(spark, d, "doc_id", "lang", "text")
    c = docs.where(T.has_content("text")).select(
        "doc_id", F.col("lang").alias("shard"), (F.octet_length(T.canonical_text("text")) + 1).alias("n_tokens"))
    return with_running_sums(c, ["doc_id"], {"start": F.col("n_tokens")}, partition_by=["shard"],
                             exclusive=True).select("shard", "doc_id", "start", F.col("n_tokens").cast("bigint"))


_CHUNK_TABLES: dict[tuple, DataFrame] = {}


def _chunks(spark, d):
    """The byte-level shards of the corpus (one per language), written once per session and input
    to the shared folder and read back by later queries — as the reference writes its shard files
    once and every later step reads them."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _CHUNK_TABLES:
        docs = tables.documents(spark, d, "doc_id", "lang", "text")
        c = docs.where(T.has_content("text")).select(
            F.col("lang").alias("shard"), F.col("doc_id").alias("ord"), T.canonical_text("text").alias("text"))
        pieces = BL.raw_pieces(c, piece_chars=shards.PIECE_CHARS, eos_piece=shards.EOS_PIECE)
        _CHUNK_TABLES[key] = shards.pack_pieces(pieces, CHUNK)
    return _CHUNK_TABLES[key]


@query("shard_meta", _BYTE_DOCS_SQL + """
SELECT shard, sum(len(ids))::BIGINT AS tokens, 'int32' AS dtype FROM b GROUP BY shard""")
def q_shard_meta(spark, d):
    return shards.shard_meta(_chunks(spark, d))


# --- W4 ---------------------------------------------------------------------------------------
_SPLIT_SQL = _BYTE_DOCS_SQL + f""",
m AS (SELECT shard, sum(len(ids))::BIGINT AS n FROM b GROUP BY shard),
sp AS (SELECT shard, n AS total_before,
              CASE WHEN n - greatest(1, floor(n * {TRAIN_FRAC})::BIGINT) < 1 THEN n - 1
                   ELSE greatest(1, floor(n * {TRAIN_FRAC})::BIGINT) END AS train_tokens FROM m)"""


@query("val_split", _SPLIT_SQL + """
SELECT shard, total_before, train_tokens::BIGINT AS train_tokens,
       (total_before - train_tokens)::BIGINT AS val_tokens FROM sp""")
def q_val_split(spark, d):
    return shards.split_counts(shards.shard_meta(_chunks(spark, d)), TRAIN_FRAC)


@query("chunk_stats", _SPLIT_SQL + f""",
pk AS (SELECT shard, doc_id, ids,
              sum(len(ids)) OVER (PARTITION BY shard ORDER BY doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len(ids) AS start
       FROM b),
tok AS (SELECT shard, start + generate_subscripts(ids, 1) - 1 AS pos, unnest(ids) AS id FROM pk),
lab AS (SELECT CASE WHEN tok.pos < sp.train_tokens THEN tok.shard ELSE tok.shard || '_val' END AS shard,
               CASE WHEN tok.pos < sp.train_tokens THEN tok.pos ELSE tok.pos - sp.train_tokens END AS pos,
               tok.id
        FROM tok JOIN sp USING (shard))
SELECT shard, (pos // {CHUNK})::BIGINT AS chunk_id, ((pos // {CHUNK}) * {CHUNK})::BIGINT AS start,
       count(*)::INTEGER AS n_ids, sum(id)::BIGINT AS sum_ids,
       arg_min(id, pos)::INTEGER AS first_id, arg_max(id, pos)::INTEGER AS last_id
FROM lab GROUP BY 1, 2, 3""")
def q_chunk_stats(spark, d):
    ch = _chunks(spark, d)
    sp = shards.split_chunks(ch, shards.split_counts(shards.shard_meta(ch), TRAIN_FRAC), chunk_size=CHUNK)
    return sp.select("shard", "chunk_id", "start", F.size("ids").alias("n_ids"),
                     F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_ids"),
                     F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


# --- A3 U3 ------------------------------------------------------------------------------------
@query("byte_vocab_usage", _BYTE_DOCS_SQL + f""",
u AS (SELECT DISTINCT shard, unnest(ids) AS id FROM b)
SELECT shard, {BL.BASE_VOCAB_SIZE} AS vocab_size, count(*)::BIGINT AS unique_ids,
       round(count(*) / {BL.BASE_VOCAB_SIZE} * 100, 2) AS coverage_pct,
       min(id)::INTEGER AS min_id, max(id)::INTEGER AS max_id
FROM u GROUP BY shard""")
def q_byte_vocab_usage(spark, d):
    return shards.vocab_usage(_chunks(spark, d), BL.BASE_VOCAB_SIZE)


# --- A16: corpus summary with a grand-total row ----------------------------------------------
@query("corpus_summary", _BYTE_DOCS_SQL + """,
j AS (SELECT c.source, octet_length(encode(c.text)) + 1 AS bytes, len(b.ids) AS tokens
      FROM c JOIN b USING (doc_id)),
r AS (SELECT source, count(*)::BIGINT AS docs, sum(bytes)::BIGINT AS bytes, sum(tokens)::BIGINT AS tokens
      FROM j GROUP BY ROLLUP (source))
SELECT source, docs, bytes, tokens,
       round(tokens / (SELECT sum(tokens) FROM j), 6) AS token_share FROM r""")
def q_corpus_summary(spark, d):
    from tessera.operators.stats import corpus_summary
    docs = tables.documents(spark, d, "doc_id", "source", "text")
    c = docs.select("doc_id", "source", T.canonical_text("text").alias("text")).where(
        filters.non_empty("text"))
    return corpus_summary(c.select("source", (F.octet_length("text") + 1).alias("bytes"),
                                   (F.octet_length("text") + 1).alias("tokens")))


# --- J5: manifest upsert (older load: all shards, newer load: all but the first by name) ------------------------------
@query("manifest_upsert", _BYTE_DOCS_SQL + """,
old AS (SELECT shard, sum(len(ids))::BIGINT AS tokens FROM b GROUP BY shard),
new AS (SELECT shard, (sum(len(ids)) * 2)::BIGINT AS tokens FROM b WHERE shard > (SELECT min(shard) FROM b) GROUP BY shard)
SELECT shard, tokens, 'int32' AS dtype FROM old WHERE shard NOT IN (SELECT shard FROM new)
UNION ALL SELECT shard, tokens, 'int32' AS dtype FROM new""")
def q_manifest_upsert(spark, d):
    # token totals need only byte counts (+1 EOS per document), not the id arrays
    docs = tables.documents(spark, d, "doc_id", "lang", "text")
    b = docs.where(T.has_content("text")).select(
        F.col("lang").alias("shard"), (F.octet_length(T.canonical_text("text")) + 1).alias("n"))
    agg = lambda df: df.groupBy("shard").agg(F.sum("n").cast("bigint").alias("tokens"))
    old = agg(b).withColumn("dtype", F.lit(shards.DTYPE))
    first = old.agg(F.min("shard")).first()[0]
    new = (agg(b.where(F.col("shard") > first))
           .withColumn("tokens", F.col("tokens") * 2).withColumn("dtype", F.lit(shards.DTYPE)))
    return shards.upsert_meta(old, new)


# --- J1: incremental dedupe (older load: first half of the id range) --------------------------
@query("incremental_dedupe", f"""
WITH c AS ({_CLEAN_DOCS}), k AS (SELECT *, sha1(text) AS sha1 FROM c WHERE text <> ''),
h AS (SELECT (max(doc_id) + 1) // 2 AS mid FROM documents),
a AS (SELECT k.* FROM k, h WHERE doc_id < mid), bb AS (SELECT k.* FROM k, h WHERE doc_id >= mid),
nb AS (SELECT * FROM bb WHERE sha1 NOT IN (SELECT sha1 FROM a))
SELECT doc_id, sha1 FROM nb QUALIFY row_number() OVER (PARTITION BY sha1 ORDER BY doc_id) = 1""")
def q_incremental_dedupe(spark, d):
    c = _cleaned(spark, d)
    mid = (tables.table(spark, d, "documents", "doc_id").agg(F.max("doc_id")).first()[0] + 1) // 2
    first = c.where(F.col("doc_id") < mid)
    second = c.where(F.col("doc_id") >= mid)
    return dedupe.incremental_dedupe(first, second).select("doc_id", "sha1")
