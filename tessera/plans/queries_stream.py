"""Structured Streaming queries. Each runs its stream to completion (``availableNow``) into a
table in the shared folder and returns that table, so the result can be compared like any batch
query. Oracles are the SQL of the batch twins: the stream must produce the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import bpe, langid
from tessera.plans import queries_apps as A
from tessera.plans import queries_models as M
from tessera.plans import sql as S
from tessera.plans.queries import CAP_BATCH_DOCS, CAP_STATS_SQL, GATED_SQL, ORACLE, cap_sql, lang_profile, query, reason_column
from tessera.session import shared_dir
from tessera.sources import tables
from tessera.streaming import capped, epochs, heartbeat, stateful
from tessera.streaming.common import ProgressListener, table_stream, to_parquet

# ---------------------------------------------------------------------------
# Fixed query parameters
# ---------------------------------------------------------------------------
N_GRAM = 3
REPEAT_WINDOW = 64
ROLL = 20


def _path(d: str, t: str) -> str:
    return f"{d.rstrip('/')}/{t}.parquet"


# --- D3: online dedupe (same rows as the batch dedupe) ---------------------------------------------
@query("stream_dedupe", ORACLE["clean_dedupe"])
def q_stream_dedupe(spark, d):
    s = table_stream(spark, _path(d, "documents")).select(
        "doc_id", "source", "text", F.col("doc_id").alias("ord"))
    return spark.read.parquet(epochs.online_dedupe(s)).select("doc_id", "source", "sha1", "text")


# --- T5 / T4 -------------------------------------------------------------------------------------------
@query("stream_rate_quota", ORACLE["rate_quota"])
def q_stream_rate_quota(spark, d):
    s = table_stream(spark, _path(d, "events")).select("event_id", "user_id", "ts")
    return spark.read.parquet(epochs.quota(s, "user_id", "ts", "event_id", A.QUOTA)).select("event_id", "user_id", "accepted")


@query("stream_rate_sliding", ORACLE["rate_sliding"])
def q_stream_rate_sliding(spark, d):
    s = table_stream(spark, _path(d, "events")).select("event_id", "user_id", "ts")
    out = to_parquet(stateful.sliding(s, "user_id", "ts", "event_id", A.RATE_PER_MIN), "stream_sliding")
    return spark.read.parquet(out).select("event_id", "user_id", "accepted")


# --- T1: gate and encode each micro-batch, stop at the cap (same counters as the batch prefix) -------
_RAW_WORDS = f"""
        UNION ALL SELECT unnest({S.words_raw('text')}) AS word, 0 AS n FROM gated WHERE reason = 'kept'"""
_STREAM_SQL = M.bpe_sql(GATED_SQL.strip().removeprefix("WITH ") + ",\n", _RAW_WORDS) + f""",
lens AS (SELECT doc_id, sum(n)::BIGINT AS n
         FROM (SELECT doc_id, unnest({S.words_raw('text')}) AS word FROM gated WHERE reason = 'kept') JOIN wt USING (word)
         GROUP BY doc_id)"""


@query("stream_capped", cap_sql(_STREAM_SQL, "coalesce((SELECT n FROM lens WHERE lens.doc_id = gated.doc_id), 0) + 1")
       + CAP_STATS_SQL)
def q_stream_capped(spark, d):
    model = M._model(spark, d)
    passed = reason_column(langid.pack(lang_profile(spark, d))) == "kept"

    def encode(docs):
        return bpe.encode_pieces(docs, model)

    docs = tables.table(spark, d, "documents", "doc_id", "text").where(passed)
    whole = encode(docs.select(F.lit("stream").alias("shard"), F.col("doc_id").alias("ord"), "text"))
    total = whole.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    cap = max(1, int(total) // 2)
    s = table_stream(spark, _path(d, "documents")).select("doc_id", "text")
    # a trigger that goes on for ever: the query ends because the cap is reached
    _, state, _ = capped.stream_capped(s, "doc_id", "text", passed, encode, cap, CAP_BATCH_DOCS, "stream",
                                       trigger={"processingTime": "1 second"} if total else None)
    return capped.stats_frame(spark, state, cap)


# --- T3: progress of a gated stream, as its listener was told ------------------------------------------
@query("stream_progress", GATED_SQL + """
SELECT count(*)::BIGINT AS seen, count(*) FILTER (WHERE reason = 'kept')::BIGINT AS kept,
       count(*) FILTER (WHERE reason <> 'kept')::BIGINT AS dropped,
       coalesce(sum(octet_length(encode(text)) + 1) FILTER (WHERE reason = 'kept'), 0)::BIGINT AS tokens FROM gated""")
def q_stream_progress(spark, d):
    reason = reason_column(langid.pack(lang_profile(spark, d)))
    s = table_stream(spark, _path(d, "documents")).select(
        "doc_id", reason.alias("reason"), (F.octet_length("text") + 1).cast("bigint").alias("n_tokens"))
    kept = F.col("reason") == "kept"
    s = s.observe("ingest", F.count(F.lit(1)).alias("seen"), F.count(F.when(kept, 1)).alias("kept"),
                  F.coalesce(F.sum(F.when(kept, F.col("n_tokens"))), F.lit(0)).alias("tokens"))
    listener = ProgressListener(spark, "ingest")
    try:
        to_parquet(s.where(kept).select("doc_id"), "stream_progress")
        rows = [(r["batch"], r["seen"], r["kept"], r["tokens"]) for r in listener.wait()]
    finally:
        listener.close()
    epochs = spark.createDataFrame(rows, "batch long, seen long, kept long, tokens long")
    return epochs.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("seen", "kept")],
                      F.coalesce(F.sum(F.col("seen") - F.col("kept")), F.lit(0)).alias("dropped"),
                      F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))


# --- T6: per-sequence diagnostics over event traces --------------------------------------------------
_TRACE_TOKEN = "(('0x' || substr(md5(event_type), 1, 15))::BIGINT % 1000)"


@query("stream_diagnostics", f"""
WITH t AS (SELECT user_id AS seq_id, event_id AS pos, {_TRACE_TOKEN} AS tok, value AS entropy,
                  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
g AS (SELECT *, lag(tok, 2) OVER w::VARCHAR || ',' || lag(tok, 1) OVER w::VARCHAR || ',' || tok::VARCHAR AS ng,
             avg(entropy) OVER (w ROWS BETWEEN {ROLL - 1} PRECEDING AND CURRENT ROW) AS avg_entropy
      FROM t WINDOW w AS (PARTITION BY seq_id ORDER BY rn)),
r AS (SELECT *, rn - lag(rn) OVER (PARTITION BY seq_id, ng ORDER BY rn) AS dist FROM g)
SELECT seq_id, pos, round(avg_entropy, 6) AS avg_entropy,
       coalesce(rn >= {N_GRAM} AND dist <= {REPEAT_WINDOW - N_GRAM}, false) AS repeated FROM r""")
def q_stream_diagnostics(spark, d):
    s = table_stream(spark, _path(d, "events")).select(
        F.col("user_id").alias("seq_id"), F.col("event_id").alias("pos"),
        F.pmod(F.conv(F.substring(F.md5("event_type"), 1, 15), 16, 10).cast("bigint"), F.lit(1000)).alias("tok"),
        F.col("value").alias("entropy"))
    r = spark.read.parquet(epochs.diagnostics(s, "seq_id", "pos", "tok", "entropy", N_GRAM, ROLL, REPEAT_WINDOW))
    return r.select("seq_id", "pos", F.round("avg_entropy", 6).alias("avg_entropy"), "repeated")


# --- T7: heartbeat over run logs written from the events table ----------------------------------------
@query("stream_heartbeat", f"""
WITH l AS (SELECT event_type AS run, user_id, event_id, {A._LOG_LINE_SQL} AS line FROM events),
p AS (SELECT run, user_id, event_id, regexp_extract_all(line, '{A.R.STEP_PATTERN}', 1)[-1]::BIGINT AS step,
             regexp_extract_all(line, '\\b{A.R.LOSS_PATTERN}', 1)[-1]::DOUBLE AS loss FROM l)
SELECT 'run=' || run AS run, arg_max(step, (user_id, event_id))::BIGINT AS last_step,
       arg_max(loss, (user_id, event_id)) AS last_loss FROM p GROUP BY run""")
def q_stream_heartbeat(spark, d):
    ev = tables.table(spark, d, "events", "event_id", "ts", "event_type", "user_id", "value")
    lines = A._log_lines(spark, d).join(ev.select("event_id", "event_type", "user_id"), "event_id")
    log_dir = shared_dir(spark, "logs")
    # lines by user, then event: steps go back whenever the next user's lines begin, as in resumed runs
    order = ("event_type", "user_id", "event_id")
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select(F.col("event_type").alias("run"), "line").write.partitionBy("run").text(log_dir)
    out = heartbeat.heartbeat(spark, log_dir)
    return spark.read.parquet(out)

