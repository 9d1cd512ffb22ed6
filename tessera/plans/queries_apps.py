"""Queries for conversations, logit vectors, sequence diagnostics, run logs and rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chat as C
from tessera.operators import ratelimit as RL
from tessera.operators import runs as R
from tessera.operators import scores as SC
from tessera.operators import sequences as SQ
from tessera.operators.materialize import materialize
from tessera.plans import sql as S
from tessera.plans.queries import _CLEAN_DOCS, query
from tessera.session import shared_dir
from tessera.sources import tables

# ---------------------------------------------------------------------------
# Fixed query parameters
# ---------------------------------------------------------------------------
CHAT_BUDGET = 200
STOPS = ["\n", ". ", " de ", "the"]
TOP_K = 5
TOP_P = 0.9
DRAW_TEMPERATURE = 0.8
DRAW_TOP_K = 10
SEED = 42
NGRAM = 3
REPEAT_WINDOW = 64
ROLL = 20
QUOTA = 60
RATE_PER_MIN = 2
KEEP_LAST = 3
TOKENS_PER_STEP = R.tokens_per_step(4, 8, 1024)
ACCUM = 4
LOG_EVERY = 50
EVAL_EVERY = 100


def _conv(spark, d):
    return tables.table(spark, d, "conversations", "conv_id", "turn", "role", "text")


_SQL_MARK = "CASE role WHEN 'user' THEN 'User:' WHEN 'assistant' THEN 'Assistant:' WHEN 'system' THEN 'System:' END"


# --- P13 ------------------------------------------------------------------------------------------
@query("chat_context", f"""
WITH ids AS (SELECT DISTINCT conv_id FROM conversations),
s AS (SELECT conv_id, arg_min(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id),
h AS (SELECT conv_id, string_agg({_SQL_MARK} || ' ' || coalesce(text, ''), chr(10) ORDER BY turn) AS body,
             count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id)
SELECT ids.conv_id,
       concat_ws(chr(10), 'System: ' || coalesce(s.system, '{C.SYSTEM_DEFAULT}'), h.body, 'Assistant:') AS context,
       coalesce(h.n, 0)::BIGINT AS n_messages
FROM ids LEFT JOIN s USING (conv_id) LEFT JOIN h USING (conv_id)""")
def q_chat_context(spark, d):
    return C.repl_context(_conv(spark, d))


_PAIRS_SQL = """
WITH ids AS (SELECT DISTINCT conv_id FROM conversations),
s AS (SELECT conv_id, {pick}(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id),
r AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS k
      FROM conversations WHERE role IN ('user', 'assistant')),
p AS (SELECT u.conv_id, u.k, 'User: ' || coalesce(u.text, '') || chr(10) || 'Assistant: ' || coalesce(a.text, '') AS line
      FROM r u JOIN r a ON u.conv_id = a.conv_id AND u.k = a.k AND u.role = 'user' AND a.role = 'assistant'),
b AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS body FROM p GROUP BY conv_id),
c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS nu, count(*) FILTER (WHERE role = 'assistant') AS na,
             arg_max(text, turn) FILTER (WHERE role = 'user') AS last_user FROM r GROUP BY conv_id)"""


@query("chat_pairs_last_system", _PAIRS_SQL.format(pick="arg_max") + """
SELECT ids.conv_id, concat_ws(chr(10), 'System: ' || coalesce(s.system, ''), b.body, 'Assistant:') AS context
FROM ids LEFT JOIN s USING (conv_id) LEFT JOIN b USING (conv_id)""")
def q_chat_pairs_last_system(spark, d):
    return C.paired_context(_conv(spark, d), "last", False)


@query("chat_pairs_first_system", _PAIRS_SQL.format(pick="arg_min") + """
SELECT ids.conv_id,
       concat_ws(chr(10), 'System: ' || coalesce(s.system, ''), b.body,
                 CASE WHEN c.nu > c.na THEN 'User: ' || coalesce(c.last_user, '') END, 'Assistant:') AS context
FROM ids LEFT JOIN s USING (conv_id) LEFT JOIN b USING (conv_id) LEFT JOIN c USING (conv_id)""")
def q_chat_pairs_first_system(spark, d):
    return C.paired_context(_conv(spark, d), "first", True)


# --- W14 (tokens = whitespace words) -----------------------------------------------------------------
def _wc(expr: str) -> str:
    n = S.normalize_doc(expr)
    return f"(CASE WHEN {n} = '' THEN 0 ELSE len(string_split({n}, ' ')) END)"


@query("chat_truncated", f"""
WITH ids AS (SELECT DISTINCT conv_id FROM conversations),
s AS (SELECT conv_id, arg_min(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id),
f AS (SELECT ids.conv_id, coalesce(s.system, '{C.SYSTEM_DEFAULT}') AS system FROM ids LEFT JOIN s USING (conv_id)),
fx AS (SELECT conv_id, system, {_wc("'System: ' || system")} + 1 AS fixed FROM f),
m AS (SELECT conv_id, turn, {_SQL_MARK} || ' ' || coalesce(text, '') AS line FROM conversations
      WHERE role IN ('user', 'assistant')),
mt AS (SELECT conv_id, turn, line, {_wc('line')} AS n_tok FROM m),
rs AS (SELECT conv_id, turn, line, sum(n_tok) OVER (PARTITION BY conv_id ORDER BY turn DESC
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS suffix FROM mt),
k AS (SELECT rs.conv_id, string_agg(rs.line, chr(10) ORDER BY rs.turn) AS body, count(*) AS kept
      FROM rs JOIN fx USING (conv_id) WHERE fx.fixed + rs.suffix <= {CHAT_BUDGET} GROUP BY rs.conv_id),
o AS (SELECT fx.conv_id, concat_ws(chr(10), 'System: ' || fx.system, k.body, 'Assistant:') AS context,
             coalesce(k.kept, 0)::BIGINT AS kept_messages FROM fx LEFT JOIN k USING (conv_id))
SELECT conv_id, context, kept_messages, {_wc('context')}::BIGINT AS n_tokens FROM o""")
def q_chat_truncated(spark, d):
    return C.truncated_context(_conv(spark, d), CHAT_BUDGET)


# --- S16 ------------------------------------------------------------------------------------------------
@query("chat_jsonl", """
SELECT conv_id, to_json({'model': 'tessera',
                         'messages': list({'role': role, 'content': text} ORDER BY turn)})::VARCHAR AS json
FROM conversations GROUP BY conv_id""")
def q_chat_jsonl(spark, d):
    return C.request_records(_conv(spark, d))


# --- P14 P20 ----------------------------------------------------------------------------------------------
# Bodies by conv_id % 5: defaults, set values, explicit nulls, no messages, set values and one null
_BODY_EXTRA = ['', ',"temperature":0.2,"max_completion_tokens":7', ',"temperature":null,"stream":true', '',
               ',"stream":null,"max_completion_tokens":64,"stop":["x","y"]']
_BODY_EMPTY = '{"model":"tessera","messages":[]}'
_EXTRA_SQL = "CASE conv_id % 5 " + " ".join(f"WHEN {i} THEN {S.q(x)}" for i, x in enumerate(_BODY_EXTRA)) + " END"


@query("request_parse", f"""
WITH m AS (SELECT conv_id, to_json({{'model': 'tessera',
                         'messages': list({{'role': role, 'content': text}} ORDER BY turn)}})::VARCHAR AS js
           FROM conversations GROUP BY conv_id),
j AS (SELECT conv_id, CASE WHEN conv_id % 5 = 3 THEN {S.q(_BODY_EMPTY)}
                           ELSE left(js, length(js) - 1) || {_EXTRA_SQL} || '}}' END AS js FROM m)
SELECT conv_id, json_array_length(js, '$.messages')::INTEGER AS n_messages,
       CASE WHEN json_type(js, '$.temperature') IS NULL THEN {C.DEFAULT_TEMPERATURE}::DOUBLE
            ELSE json_extract_string(js, '$.temperature')::DOUBLE END AS temperature,
       CASE WHEN json_type(js, '$.stream') IS NULL THEN false
            ELSE json_extract_string(js, '$.stream')::BOOLEAN END AS stream,
       CASE WHEN json_type(js, '$.max_completion_tokens') IS NULL THEN {C.DEFAULT_MAX_TOKENS}
            ELSE json_extract_string(js, '$.max_completion_tokens')::INTEGER END AS max_tokens,
       coalesce(json_array_length(js, '$.stop'), 0)::INTEGER AS n_stops,
       json_extract_string(js, '$.messages[#-1].role') AS last_role,
       json_array_length(js, '$.messages') > 0 AS valid
FROM j""")
def q_request_parse(spark, d):
    extra = F.element_at(F.array(*[F.lit(x) for x in _BODY_EXTRA]), (F.col("conv_id") % 5 + 1).cast("int"))
    full = F.concat(F.expr("left(json, length(json) - 1)"), extra, F.lit("}"))
    body = F.when(F.col("conv_id") % 5 == 3, F.lit(_BODY_EMPTY)).otherwise(full)
    r = C.request_records(_conv(spark, d)).select("conv_id", C.parse_request(body).alias("r"))
    return r.select("conv_id", F.size("r.messages").alias("n_messages"), F.col("r.temperature").alias("temperature"),
                    F.col("r.stream").alias("stream"), F.col("r.max_tokens").alias("max_tokens"),
                    F.size("r.stop").alias("n_stops"),
                    F.try_element_at("r.messages", F.lit(-1))["role"].alias("last_role"), F.col("r.valid").alias("valid"))


# Single-prompt bodies by conv_id % 5: defaults, set values, nulls, no prompt, a seed
_LEGACY_EXTRA = ['', ',"temperature":0.3,"max_tokens":9', ',"temperature":null,"stream":true,"stop":["a","b"]', '',
                 ',"seed":7,"max_tokens":null']
_LEGACY_BARE = '{"max_tokens":5}'
_LEGACY_SQL = "CASE conv_id % 5 " + " ".join(f"WHEN {i} THEN {S.q(x)}" for i, x in enumerate(_LEGACY_EXTRA)) + " END"


@query("legacy_parse", f"""
WITH p AS (SELECT conv_id, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS prompt
           FROM conversations GROUP BY conv_id),
j AS (SELECT conv_id, CASE WHEN conv_id % 5 = 3 THEN {S.q(_LEGACY_BARE)} ELSE
             rtrim(to_json({{'prompt': prompt}})::VARCHAR, '}}') || {_LEGACY_SQL} || '}}' END AS js FROM p)
SELECT conv_id, CASE WHEN json_type(js, '$.prompt') IS NULL THEN '' ELSE json_extract_string(js, '$.prompt') END AS prompt,
       CASE WHEN json_type(js, '$.temperature') IS NULL THEN {C.DEFAULT_TEMPERATURE}::DOUBLE
            ELSE json_extract_string(js, '$.temperature')::DOUBLE END AS temperature,
       CASE WHEN json_type(js, '$.stream') IS NULL THEN false
            ELSE json_extract_string(js, '$.stream')::BOOLEAN END AS stream,
       CASE WHEN json_type(js, '$.max_tokens') IS NULL THEN {C.DEFAULT_MAX_TOKENS}
            ELSE json_extract_string(js, '$.max_tokens')::INTEGER END AS max_tokens,
       coalesce(json_array_length(js, '$.stop'), 0)::INTEGER AS n_stops,
       json_extract_string(js, '$.seed')::BIGINT AS seed
FROM j""")
def q_legacy_parse(spark, d):
    prompts = _conv(spark, d).groupBy("conv_id").agg(
        F.coalesce(F.max_by("text", F.when(F.col("role") == "user", F.col("turn"))), F.lit("")).alias("prompt"))
    js = F.to_json(F.struct("prompt"))
    extra = F.element_at(F.array(*[F.lit(x) for x in _LEGACY_EXTRA]), (F.col("conv_id") % 5 + 1).cast("int"))
    body = F.when(F.col("conv_id") % 5 == 3, F.lit(_LEGACY_BARE)).otherwise(
        F.concat(F.substring(js, F.lit(1), F.length(js) - 1), extra, F.lit("}")))
    r = prompts.select("conv_id", C.parse_legacy(body).alias("r"))
    return r.select("conv_id", "r.prompt", "r.temperature", "r.stream", "r.max_tokens",
                    F.size("r.stop").alias("n_stops"), "r.seed")


# Faults by conv_id % 8: none, absent, null, empty, cut off, text for a list, a list for the body, no role
_FAULTS = {1: '{"model":"m"}', 2: '{"messages":null}', 3: '{"messages":[]}', 5: '{"messages":"text"}',
           7: '{"messages":[{"role":"user","content":"x"},{"content":"y"}]}'}
_FAULT_SQL = " ".join(f"WHEN {k} THEN {S.q(x)}" for k, x in _FAULTS.items())


@query("request_rejects", f"""
WITH m AS (SELECT conv_id, to_json({{'model': 'tessera',
                         'messages': list({{'role': role, 'content': text}} ORDER BY turn)}})::VARCHAR AS js
           FROM conversations GROUP BY conv_id),
b AS (SELECT conv_id, CASE conv_id % 8 {_FAULT_SQL} WHEN 4 THEN left(js, length(js) - 1)
                                       WHEN 6 THEN '[' || js || ']' ELSE js END AS js FROM m),
v AS (SELECT conv_id, json_valid(js) AS ok, CASE WHEN json_valid(js) THEN js ELSE '{{}}' END AS js FROM b),
r AS (SELECT conv_id, CASE WHEN NOT ok THEN 'malformed body' WHEN json_type(js) <> 'OBJECT' THEN 'not an object'
                           WHEN coalesce(json_type(js, '$.messages'), 'NULL') = 'NULL' THEN 'no messages'
                           WHEN json_type(js, '$.messages') <> 'ARRAY' THEN 'messages not a list'
                           WHEN json_array_length(js, '$.messages') = 0 THEN 'no messages'
                           WHEN len(json_extract(js, '$.messages[*].role')) < json_array_length(js, '$.messages')
                           THEN 'message without a role' END AS reason FROM v)
SELECT conv_id, reason FROM r WHERE reason IS NOT NULL""")
def q_request_rejects(spark, d):
    body = F.when(F.col("conv_id") % 8 == 4, F.expr("left(json, length(json) - 1)"))
    body = body.when(F.col("conv_id") % 8 == 6, F.concat(F.lit("["), F.col("json"), F.lit("]")))
    for k, x in _FAULTS.items():
        body = body.when(F.col("conv_id") % 8 == k, F.lit(x))
    bodies = C.request_records(_conv(spark, d)).select("conv_id", body.otherwise(F.col("json")).alias("json"))
    return C.rejects(bodies).select("conv_id", "reason")


# --- S16 responses, P13 single turn ------------------------------------------------------------------------
@query("response_jsonl", f"""
WITH a AS (SELECT conv_id, max(turn) AS at, coalesce(arg_max(coalesce(text, ''), turn), '') AS text
           FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
u AS (SELECT a.conv_id, a.text, {_wc('a.text')} AS done,
             coalesce(sum({_wc("coalesce(c.text, '')")}) FILTER (WHERE c.turn < a.at), 0)::BIGINT AS asked
      FROM a JOIN conversations c ON c.conv_id = a.conv_id GROUP BY a.conv_id, a.text)
SELECT conv_id, to_json({{'id': 'chatcmpl-' || conv_id, 'object': 'chat.completion', 'created': 0, 'model': 'tessera',
    'choices': [{{'index': 0, 'message': {{'role': 'assistant', 'content': text}}, 'text': text, 'finish_reason': 'stop'}}],
    'usage': {{'prompt_tokens': asked, 'completion_tokens': done, 'total_tokens': asked + done}}}})::VARCHAR AS json
FROM u""")
def q_response_jsonl(spark, d):
    return C.response_records(_conv(spark, d))


@query("single_turn_context", """
WITH s AS (SELECT conv_id, arg_min(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id)
SELECT c.conv_id, c.turn, CASE WHEN coalesce(s.system, '') <> '' THEN 'System: ' || s.system || chr(10) ELSE '' END
       || 'User: ' || coalesce(c.text, '') || chr(10) || 'Assistant:' AS context
FROM conversations c LEFT JOIN s USING (conv_id) WHERE c.role = 'user'""")
def q_single_turn_context(spark, d):
    conv = _conv(spark, d)
    system = conv.where(F.col("role") == "system").groupBy("conv_id").agg(F.min_by("text", "turn").alias("system"))
    users = conv.where(F.col("role") == "user").join(system, "conv_id", "left")
    return users.select("conv_id", "turn", C.single_turn_context(F.col("text"), F.col("system")).alias("context"))


# --- P12 ----------------------------------------------------------------------------------------------------
def _stop_sql() -> str:
    arms = []
    for i, s in enumerate(STOPS):
        lit = S.q(s).replace("\n", "' || chr(10) || '")
        arms.append(f"CASE WHEN strpos(text, {lit}) > 0 THEN {{'e': strpos(text, {lit}) + {len(s) - 1}, "
                    f"'i': {i}, 'p': strpos(text, {lit})}} END")
    return "list_min(list_filter([" + ", ".join(arms) + "], lambda x: x IS NOT NULL))"


@query("stop_cut", f"""
WITH b AS (SELECT conv_id, turn, text, {_stop_sql()} AS best FROM conversations)
SELECT conv_id, turn, best.i::INTEGER AS stop_index,
       length(CASE WHEN best IS NULL THEN text ELSE substr(text, 1, best.p - 1) END)::INTEGER AS cut_len
FROM b""")
def q_stop_cut(spark, d):
    c = _conv(spark, d)
    cut, idx = C.stop_cut(F.col("text"), STOPS)
    return c.select("conv_id", "turn", idx.alias("stop_index"), F.char_length(cut).alias("cut_len"))


# --- P19 W10 W11 W12 M6 on embeddings as logit vectors ---------------------------------------------------------
def _emb(spark, d):
    return tables.table(spark, d, "embeddings", "vec_id", "embedding")


_SOFTMAX_SQL = """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS l FROM embeddings),
m AS (SELECT vec_id, l, list_max(l) AS mx FROM x),
e AS (SELECT vec_id, l, list_transform(l, lambda v: exp(v - mx)) AS ex FROM m),
p AS (SELECT vec_id, l, list_transform(ex, lambda v: v / list_sum(ex)) AS p FROM e)"""


@query("softmax_entropy", _SOFTMAX_SQL + f"""
SELECT vec_id, round(-list_sum(list_transform(p, lambda v: v * ln(v + {SC.EPS}))), 6) AS entropy,
       round(list_max(p), 6) AS max_p FROM p""")
def q_softmax_entropy(spark, d):
    e = _emb(spark, d)
    return e.select("vec_id", F.round(SC.entropy(F.col("embedding")), 6).alias("entropy"),
                    F.round(F.array_max(SC.softmax(F.col("embedding"))), 6).alias("max_p"))


@query("top_k_mask", f"""
WITH t AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS id FROM embeddings),
r AS (SELECT vec_id, v, id, rank() OVER (PARTITION BY vec_id ORDER BY v DESC) AS rk,
             row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, id) AS rn FROM t)
SELECT vec_id, count(*) FILTER (WHERE rk <= {TOP_K})::INTEGER AS n_kept,
       string_agg(id::VARCHAR, ',' ORDER BY rn) FILTER (WHERE rn <= {TOP_K}) AS top_ids
FROM r GROUP BY vec_id""")
def q_top_k_mask(spark, d):
    e = _emb(spark, d)
    keep = SC.top_k_mask(F.col("embedding"), TOP_K)
    top = F.transform(F.slice(SC.ranked(F.col("embedding")), 1, TOP_K), lambda s: s["id"].cast("string"))
    return e.select("vec_id", F.size(F.filter(keep, lambda b: b)).alias("n_kept"),
                    F.array_join(top, ",").alias("top_ids"))


@query("nucleus", _SOFTMAX_SQL + f""",
t AS (SELECT vec_id, unnest(p) AS pv, generate_subscripts(p, 1) - 1 AS id FROM p),
c AS (SELECT vec_id, pv, id, coalesce(sum(pv) OVER (PARTITION BY vec_id ORDER BY pv DESC, id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
SELECT vec_id, count(*) FILTER (WHERE before <= {TOP_P})::INTEGER AS n_kept FROM c GROUP BY vec_id""")
def q_nucleus(spark, d):
    e = SC.with_filtered_probs(_emb(spark, d), "embedding", "p", 1.0, None, TOP_P)
    return e.select("vec_id", SC.n_kept(F.col("p")).alias("n_kept"))


@query("argmax", """
WITH t AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS id FROM embeddings)
SELECT vec_id, arg_min(id, (-v, id))::INTEGER AS argmax_id, max(v) AS max_logit FROM t GROUP BY vec_id""")
def q_argmax(spark, d):
    e = _emb(spark, d)
    return e.select("vec_id", SC.argmax(F.col("embedding")).alias("argmax_id"),
                    F.array_max(F.transform("embedding", lambda v: v.cast("double"))).alias("max_logit"))


@query("seeded_draw", f"""
WITH t AS (SELECT vec_id, unnest(embedding)::DOUBLE / {DRAW_TEMPERATURE} AS v,
                  generate_subscripts(embedding, 1) - 1 AS id FROM embeddings),
k AS (SELECT *, rank() OVER (PARTITION BY vec_id ORDER BY v DESC) AS rk FROM t),
k2 AS (SELECT * FROM k WHERE rk <= {DRAW_TOP_K}),
s1 AS (SELECT *, exp(v - max(v) OVER (PARTITION BY vec_id)) AS ex FROM k2),
s2 AS (SELECT *, ex / sum(ex) OVER (PARTITION BY vec_id) AS p FROM s1),
nu AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s2),
kept AS (SELECT vec_id, id, v FROM nu WHERE before <= {TOP_P}),
s3 AS (SELECT *, exp(v - max(v) OVER (PARTITION BY vec_id)) AS ex FROM kept),
s4 AS (SELECT vec_id, id, ex / sum(ex) OVER (PARTITION BY vec_id) AS p FROM s3),
cum AS (SELECT vec_id, id, p, sum(p) OVER (PARTITION BY vec_id ORDER BY id
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM s4),
u AS (SELECT vec_id, ({S.md5_int(f"'draw:{SEED}:' || vec_id::VARCHAR")})::DOUBLE / {float(2 ** 60)} AS u FROM embeddings)
SELECT u.vec_id, coalesce(min(cum.id) FILTER (WHERE cum.c > u.u), max(cum.id))::INTEGER AS token
FROM u JOIN cum USING (vec_id) GROUP BY u.vec_id""")
def q_seeded_draw(spark, d):
    e = SC.with_filtered_probs(_emb(spark, d), "embedding", "p", DRAW_TEMPERATURE, DRAW_TOP_K, TOP_P)
    return e.select("vec_id", SC.draw(F.col("p"), F.lit("draw"), F.lit(str(SEED)), F.col("vec_id").cast("string"))
                    .alias("token"))


# --- W13 -----------------------------------------------------------------------------------------------
@query("ngram_repeats", f"""
WITH c AS ({_CLEAN_DOCS}),
w AS (SELECT doc_id, {S.words('text')} AS ws FROM c WHERE text <> ''),
g AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, ws FROM w),
n AS (SELECT doc_id, i, array_to_string(ws[i:i + {NGRAM - 1}], chr(1)) AS ng FROM g WHERE i + {NGRAM - 1} <= len(ws)),
l AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id, ng ORDER BY i) AS d FROM n)
SELECT doc_id, count(*)::BIGINT AS n_ngrams,
       count(*) FILTER (WHERE d <= {REPEAT_WINDOW - NGRAM})::BIGINT AS n_repeats FROM l GROUP BY doc_id""")
def q_ngram_repeats(spark, d):
    docs = tables.documents(spark, d, "doc_id", "text")
    c = docs.where(T.has_content("text")).select("doc_id", T.canonical_text("text").alias("text"))
    r = SQ.ngram_repeats(c.select("doc_id", T.words("text").alias("ws")), "doc_id", "ws", NGRAM, REPEAT_WINDOW)
    return r.groupBy("doc_id").agg(F.count(F.lit(1)).cast("bigint").alias("n_ngrams"),
                                   F.count(F.when(F.col("repeated"), F.lit(1))).cast("bigint").alias("n_repeats"))


# --- A17 -------------------------------------------------------------------------------------------------
@query("rolling_entropy", f"""
SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                                 ROWS BETWEEN {ROLL - 1} PRECEDING AND CURRENT ROW), 6) AS rolling
FROM events""")
def q_rolling_entropy(spark, d):
    ev = tables.table(spark, d, "events", "event_id", "user_id", "ts", "value")
    r = SQ.rolling_mean(ev, "user_id", ["ts", "event_id"], "value", ROLL)
    return r.select("event_id", "user_id", F.round("rolling", 6).alias("rolling"))


# --- T5 T4 (batch) ----------------------------------------------------------------------------------------
@query("rate_quota", f"""
SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {QUOTA} AS accepted
FROM events""")
def q_rate_quota(spark, d):
    ev = tables.table(spark, d, "events", "event_id", "user_id", "ts")
    return RL.fixed_quota(ev, "user_id", ["ts", "event_id"], QUOTA).select("event_id", "user_id", "accepted")


@query("rate_sliding", f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1000000.0, event_id) AS rn FROM events),
r AS (
  SELECT user_id, rn, event_id, t, true AS acc, [t] AS win FROM e WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, e.t,
         len(list_filter(r.win, lambda x: e.t - x < {RL.WINDOW_SECONDS})) < {RATE_PER_MIN} AS acc,
         CASE WHEN len(list_filter(r.win, lambda x: e.t - x < {RL.WINDOW_SECONDS})) < {RATE_PER_MIN}
              THEN list_append(list_filter(r.win, lambda x: e.t - x < {RL.WINDOW_SECONDS}), e.t)
              ELSE list_filter(r.win, lambda x: e.t - x < {RL.WINDOW_SECONDS}) END AS win
  FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT event_id, user_id, acc AS accepted FROM r""")
def q_rate_sliding(spark, d):
    ev = tables.table(spark, d, "events", "event_id", "user_id", "ts")
    return RL.sliding_window(ev, "user_id", "ts", "event_id", RATE_PER_MIN).select("event_id", "user_id", "accepted")


# --- run logs: P21 A13 W16 W15 A18 A14 A15 W17 W18 --------------------------------------------------------
_LOG_LINE_SQL = """'ts=' || ts::VARCHAR || ' run=' || event_type || ' step=' || user_id::VARCHAR || ' loss='
  || value::DECIMAL(10, 2)::VARCHAR || ' step=' || event_id::VARCHAR || ' val_loss=' || (value * 2)::DECIMAL(10, 2)::VARCHAR"""

_METRICS_SQL = """
WITH mt AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step,
                   ts, value AS loss, value AS val_loss FROM events)"""


def _log_lines(spark, d):
    ev = tables.table(spark, d, "events", "event_id", "ts", "event_type", "user_id", "value")
    line = F.concat(F.lit("ts="), F.col("ts").cast("string"), F.lit(" run="), F.col("event_type"),
                    F.lit(" step="), F.col("user_id").cast("string"),
                    F.lit(" loss="), F.col("value").cast("decimal(10,2)").cast("string"),
                    F.lit(" step="), F.col("event_id").cast("string"),
                    F.lit(" val_loss="), (F.col("value") * 2).cast("decimal(10,2)").cast("string"))
    return ev.select("event_id", line.alias("line"))


@query("run_log_parse", f"""
WITH l AS (SELECT event_id, {_LOG_LINE_SQL} AS line FROM events)
SELECT event_id, regexp_extract_all(line, '{R.STEP_PATTERN}', 1)[-1]::BIGINT AS step,
       regexp_extract_all(line, '\\b{R.LOSS_PATTERN}', 1)[-1]::DOUBLE AS loss FROM l""")
def q_run_log_parse(spark, d):
    step, loss = R.parse_log_line(F.col("line"))
    return _log_lines(spark, d).select("event_id", step.alias("step"), loss.alias("loss"))


def _metrics(spark, d):
    ev = tables.table(spark, d, "events", "event_id", "ts", "event_type", "value")
    m = R.with_step(ev.withColumnRenamed("event_type", "run"), "run", ["ts", "event_id"])
    return m.select("run", "step", "ts", F.col("value").alias("loss"), F.col("value").alias("val_loss"))


@query("best_step", _METRICS_SQL + """
SELECT run, arg_min(step, (val_loss, step))::BIGINT AS best_step, min(val_loss) AS best_loss FROM mt GROUP BY run""")
def q_best_step(spark, d):
    return R.best_step(_metrics(spark, d))


@query("running_best", _METRICS_SQL + """
SELECT run, step::BIGINT AS step, min(val_loss) OVER (PARTITION BY run ORDER BY step
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far FROM mt""")
def q_running_best(spark, d):
    return R.running_best(_metrics(spark, d)).select("run", "step", "best_so_far")


@query("retention", _METRICS_SQL + f"""
SELECT run, step::BIGINT AS step FROM mt QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) <= {KEEP_LAST}""")
def q_retention(spark, d):
    return R.keep_last(_metrics(spark, d).select("run", "step"), KEEP_LAST)


# Artefacts at a twentieth of the longest run's steps, stored as folders, one step a run under a foreign name
@query("retention_listing", _METRICS_SQL + f""",
every AS (SELECT greatest(max(step) // 20, 1) AS k FROM mt),
saved AS (SELECT run, step FROM mt, every WHERE step % k = 0 AND step <> k)
SELECT run, step::BIGINT AS step FROM saved
QUALIFY row_number() OVER (PARTITION BY run ORDER BY step DESC) <= {KEEP_LAST}""")
def q_retention_listing(spark, d):
    steps = _metrics(spark, d).select("run", "step")
    top = steps.agg(F.max("step")).first()[0] or 0
    k = max(top // 20, 1)
    name = F.when(F.col("step") == k, "notes.txt").otherwise(F.concat(F.lit("step_"), F.col("step"), F.lit(".pt")))
    path = shared_dir(spark, "saved")
    (steps.where(F.col("step") % k == 0).select("run", name.alias("name"), F.col("step").cast("string").alias("value"))
     .repartition("run", "name").write.partitionBy("run", "name").text(path))
    listing = R.listed_artifacts(spark, f"{path}/run=*/name=*/part-*")
    R.apply_prune(materialize(R.prune_plan(listing, KEEP_LAST), "prune"))
    left = R.listed_artifacts(spark, f"{path}/run=*/name=*/part-*")
    return left.select(F.regexp_extract("folder", "run=([^/]*)/", 1).alias("run"), "step")


@query("latest_status", _METRICS_SQL + """
SELECT run, max(step)::BIGINT AS last_step, arg_max(loss, step) AS last_loss FROM mt GROUP BY run""")
def q_latest_status(spark, d):
    return R.latest_status(_metrics(spark, d))


@query("throughput", _METRICS_SQL + f""",
lg AS (SELECT run, step, ts, lag(ts) OVER (PARTITION BY run ORDER BY step) AS prev FROM mt)
SELECT run, step::BIGINT AS step,
       round({float(TOKENS_PER_STEP)} / greatest((epoch_us(ts) - epoch_us(prev)) / 1e6, 1e-9), 6) AS tok_s
FROM lg WHERE prev IS NOT NULL""")
def q_throughput(spark, d):
    t = R.throughput(_metrics(spark, d), TOKENS_PER_STEP)
    return t.where(F.col("tok_s").isNotNull()).select("run", "step", F.round("tok_s", 6).alias("tok_s"))


@query("step_means", _METRICS_SQL + f"""
SELECT run, ((step - 1) // {ACCUM} + 1)::BIGINT AS step, round(avg(loss), 6) AS loss,
       count(*)::BIGINT AS micro_batches FROM mt GROUP BY 1, 2""")
def q_step_means(spark, d):
    m = _metrics(spark, d).withColumnRenamed("step", "micro")
    r = R.step_means(m, ACCUM)
    return r.select("run", "step", F.round("loss", 6).alias("loss"), "micro_batches")


@query("log_every", _METRICS_SQL + f"""
SELECT run, step::BIGINT AS step, loss FROM mt WHERE step % {LOG_EVERY} = 0""")
def q_log_every(spark, d):
    return R.every_nth(_metrics(spark, d), LOG_EVERY).select("run", "step", "loss")


@query("trajectory", _METRICS_SQL + f""",
ev AS (SELECT run, step, val_loss FROM mt WHERE step % {EVAL_EVERY} = 0)
SELECT run, step::BIGINT AS step, val_loss,
       val_loss - lag(val_loss) OVER (PARTITION BY run ORDER BY step) AS delta FROM ev""")
def q_trajectory(spark, d):
    ev = R.every_nth(_metrics(spark, d), EVAL_EVERY)
    return R.trajectory(ev).select("run", "step", "val_loss", "delta")


# --- X3 P19 W10: per-token trace records (greedy token, entropy, top-5) ---------------------------
@query("token_trace", _SOFTMAX_SQL + f""",
t AS (SELECT vec_id, unnest(p) AS pv, generate_subscripts(p, 1) - 1 AS id FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY pv DESC, id) AS rn FROM t),
top AS (SELECT vec_id, string_agg(id::VARCHAR, ',' ORDER BY rn) AS top5_ids,
               string_agg(round(pv, 6)::VARCHAR, ',' ORDER BY rn) AS top5_p FROM r WHERE rn <= 5 GROUP BY vec_id),
am AS (SELECT vec_id, min(id) FILTER (WHERE rn = 1) AS token_id FROM r GROUP BY vec_id)
SELECT p.vec_id, am.token_id::INTEGER AS token_id,
       round(-list_sum(list_transform(p.p, lambda v: v * ln(v + {SC.EPS}))), 6) AS entropy,
       top.top5_ids, top.top5_p
FROM p JOIN am USING (vec_id) JOIN top USING (vec_id)""")
def q_token_trace(spark, d):
    t = SC.trace(_emb(spark, d), "vec_id", "embedding")
    return t.select("vec_id", "token_id", F.round("entropy", 6).alias("entropy"),
                    F.array_join(F.transform("top5", lambda s: s["id"].cast("string")), ",").alias("top5_ids"),
                    F.array_join(F.transform("top5", lambda s: F.round(s["p"], 6).cast("string")), ",")
                    .alias("top5_p"))


# --- P11: fit a context to the model window (byte tokens as the tokenizer stand-in) ----------------
MAX_CTX = 1024
MAX_NEW = 128


@query("context_fit", f"""
WITH ids AS (SELECT DISTINCT conv_id FROM conversations),
s AS (SELECT conv_id, arg_min(text, turn) AS system FROM conversations WHERE role = 'system' GROUP BY conv_id),
h AS (SELECT conv_id, string_agg({_SQL_MARK} || ' ' || coalesce(text, ''), chr(10) ORDER BY turn) AS body
      FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id),
c AS (SELECT ids.conv_id, concat_ws(chr(10), 'System: ' || coalesce(s.system, '{C.SYSTEM_DEFAULT}'), h.body,
                                     'Assistant:') AS context
      FROM ids LEFT JOIN s USING (conv_id) LEFT JOIN h USING (conv_id)),
n AS (SELECT conv_id, octet_length(encode(context)) AS n FROM c)
SELECT conv_id, n::INTEGER AS n_prompt, (CASE WHEN n >= {MAX_CTX} THEN {MAX_CTX - 1} ELSE n END)::INTEGER AS n_kept,
       least({MAX_NEW}, {MAX_CTX} - (CASE WHEN n >= {MAX_CTX} THEN {MAX_CTX - 1} ELSE n END))::INTEGER AS budget,
       (CASE WHEN n >= {MAX_CTX} THEN list_sum({S.base_ids('context')}[n - {MAX_CTX - 2}:])
             ELSE list_sum({S.base_ids('context')}) END)::BIGINT AS sum_kept
FROM n JOIN c USING (conv_id)""")
def q_context_fit(spark, d):
    from tessera.functions import bytelevel as BL
    ctx = C.repl_context(_conv(spark, d))
    ids = ctx.select("conv_id", BL.base_ids("context").alias("ids"))
    kept, budget = C.fit_context(F.col("ids"), MAX_CTX, MAX_NEW)
    return ids.select("conv_id", F.size("ids").alias("n_prompt"), F.size(kept).alias("n_kept"),
                      budget.cast("int").alias("budget"),
                      F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_kept"))
