"""Queries for windows, sampling and evaluation over the byte-level shards (one shard per language)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import bytelevel as BL
from tessera.operators import evaluate as EV
from tessera.operators import sampling as SM
from tessera.operators import shards
from tessera.operators import windows as W
from tessera.operators.materialize import materialize
from tessera.plans import sql as S
from tessera.plans.queries import _BYTE_DOCS_SQL, TRAIN_FRAC, _chunks, query

# ---------------------------------------------------------------------------
# Fixed query parameters
# ---------------------------------------------------------------------------
EVAL_CTX = 256
SAMPLE_CTX = 128
SEED = 42
# copies of a manifest's shards in a mixture list, in the order of their names, repeating
MIX_COPIES = [1]
UPWEIGHT_COPIES = [1, 3, 2]
BIGRAM_CTX = 64
EVAL_BATCH = 4
EVAL_MAX_BATCHES = 5

_TOK_SQL = _BYTE_DOCS_SQL + """,
pk AS (SELECT shard, doc_id, ids,
              sum(len(ids)) OVER (PARTITION BY shard ORDER BY doc_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len(ids) AS start
       FROM b),
tok AS (SELECT shard, start + generate_subscripts(ids, 1) - 1 AS pos, unnest(ids) AS id FROM pk),
m AS (SELECT shard, count(*) AS n FROM tok GROUP BY shard)"""


def _meta(spark, d):
    ch = _chunks(spark, d)
    return ch, materialize(shards.shard_meta(ch), "shard_meta")


# --- W5 J3 P16 ----------------------------------------------------------------------------------
@query("eval_windows", _TOK_SQL + f""",
nw AS (SELECT shard, CASE WHEN n >= {EVAL_CTX + 1} THEN (n - {EVAL_CTX + 1}) // {EVAL_CTX} + 1 ELSE 0 END AS nw FROM m),
wt AS (SELECT shard, pos // {EVAL_CTX} AS w, pos % {EVAL_CTX} AS j, id FROM tok
       UNION ALL
       SELECT shard, pos // {EVAL_CTX} - 1 AS w, {EVAL_CTX} AS j, id FROM tok WHERE pos % {EVAL_CTX} = 0 AND pos > 0)
SELECT wt.shard, w::BIGINT AS window_id, (w * {EVAL_CTX})::BIGINT AS start, count(*)::INTEGER AS n,
       sum(id) FILTER (WHERE j < {EVAL_CTX})::BIGINT AS sum_input,
       sum(id) FILTER (WHERE j >= 1)::BIGINT AS sum_labels,
       arg_min(id, j)::BIGINT AS first_input, arg_max(id, j)::BIGINT AS last_label
FROM wt JOIN nw USING (shard) WHERE w < nw.nw GROUP BY 1, 2, 3""")
def q_eval_windows(spark, d):
    ch, meta = _meta(spark, d)
    w = W.with_shift(W.eval_windows(ch, meta, EVAL_CTX), EVAL_CTX)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return w.select("shard", "window_id", "start",
                    (F.size("input_ids") + 1).alias("n"),
                    total("input_ids").alias("sum_input"), total("labels").alias("sum_labels"),
                    F.element_at("input_ids", 1).alias("first_input"),
                    F.element_at("labels", -1).alias("last_label"))


# --- P18 ----------------------------------------------------------------------------------------
@query("window_shift_check", _TOK_SQL + f""",
nw AS (SELECT shard, CASE WHEN n >= {EVAL_CTX + 1} THEN (n - {EVAL_CTX + 1}) // {EVAL_CTX} + 1 ELSE 0 END AS nw FROM m)
SELECT shard, nw::BIGINT AS n_windows, nw::BIGINT AS n_valid FROM nw WHERE nw > 0""")
def q_window_shift_check(spark, d):
    ch, meta = _meta(spark, d)
    w = W.with_shift(W.eval_windows(ch, meta, EVAL_CTX), EVAL_CTX)
    return w.groupBy("shard").agg(F.count(F.lit(1)).cast("bigint").alias("n_windows"),
                                  F.count(F.when(W.valid(EVAL_CTX), F.lit(1))).cast("bigint").alias("n_valid"))


# --- W8 -----------------------------------------------------------------------------------------
@query("epoch_len", _TOK_SQL + f"""
SELECT shard, greatest(1, n // {EVAL_CTX + 1})::BIGINT AS epoch_len FROM m""")
def q_epoch_len(spark, d):
    _, meta = _meta(spark, d)
    return shards.epoch_len(meta, EVAL_CTX)


# --- A9 U2 --------------------------------------------------------------------------------------
def _shard_list(meta, copies: list[int]) -> list[str]:
    """A mixture list of all shards of the manifest (one row per shard), some of them repeated."""
    names = sorted((r["shard"] for r in meta.select("shard").collect()), key=lambda n: (n is None, n or ""))  # null last
    return [n for k, n in enumerate(names) for _ in range(copies[k % len(copies)])]


def _mix_sql(copies: list[int]) -> str:
    cycle = "[" + ", ".join(map(str, copies)) + "]"
    return _TOK_SQL + f""",
nm AS (SELECT shard, row_number() OVER (ORDER BY shard) - 1 AS k FROM m),
cp AS (SELECT shard, {cycle}[k % {len(copies)} + 1] AS copies, k FROM nm),
l AS (SELECT (sum(copies) OVER (ORDER BY k) - copies)::INTEGER AS shard_rank, shard, copies FROM cp),
t AS (SELECT l.shard_rank, l.shard, l.copies, m.n AS tokens, (l.copies * m.n) AS weight FROM l JOIN m USING (shard)),
cw AS (SELECT *, sum(weight) OVER () AS tot,
             sum(weight) OVER (ORDER BY shard_rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             max(shard_rank) OVER () AS last FROM t)"""


def _mix_select() -> str:
    return """
SELECT shard_rank::INTEGER AS shard_rank, shard, copies::INTEGER AS copies, tokens::BIGINT AS tokens,
       weight::BIGINT AS weight, weight / tot AS p, (cum - weight) / tot AS cum_lo,
       CASE WHEN shard_rank = last THEN 1.0 ELSE cum / tot END AS cum_hi FROM cw"""


@query("mix_weights", _mix_sql(MIX_COPIES) + _mix_select())
def q_mix_weights(spark, d):
    _, meta = _meta(spark, d)
    return SM.mix_weights(meta, _shard_list(meta, MIX_COPIES))


@query("upweighted_mix", _mix_sql(UPWEIGHT_COPIES) + _mix_select())
def q_upweighted_mix(spark, d):
    _, meta = _meta(spark, d)
    return SM.mix_weights(meta, _shard_list(meta, UPWEIGHT_COPIES))


# --- M1 J3 --------------------------------------------------------------------------------------
def _window_sums(df):
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.select("i", "shard", "start", F.size("w").alias("n"), total("w").alias("sum_w"),
                     F.element_at("w", 1).cast("bigint").alias("first_id"),
                     F.element_at("w", -1).cast("bigint").alias("last_id"))


_STARTS_SQL = f"""s AS (SELECT i, shard, n,
             ((({S.md5_int(f"'{SEED}:' || shard || ':' || i::VARCHAR")}) % (n - {SAMPLE_CTX})) + i * {SM.STRIDE})
               % (n - {SAMPLE_CTX}) AS start
      FROM idx)"""
_SAMPLE_AGG = f""",
want AS (SELECT s.i, s.shard, s.start, (s.start + r.range)::BIGINT AS pos FROM s, range(0, {SAMPLE_CTX + 1}) r)
SELECT want.i::BIGINT AS i, want.shard, want.start::BIGINT AS start, count(*)::INTEGER AS n, sum(tok.id)::BIGINT AS sum_w,
       arg_min(tok.id, tok.pos)::BIGINT AS first_id, arg_max(tok.id, tok.pos)::BIGINT AS last_id
FROM want JOIN tok ON tok.shard = want.shard AND tok.pos = want.pos GROUP BY 1, 2, 3"""


@query("sample_windows", _TOK_SQL + f""",
idx AS (SELECT m.shard, m.n, r.range AS i FROM m, range(0, greatest(1, m.n // {SAMPLE_CTX + 1})) r),
{_STARTS_SQL}""" + _SAMPLE_AGG)
def q_sample_windows(spark, d):
    ch, meta = _meta(spark, d)
    s = SM.shard_samples(meta, SAMPLE_CTX, SEED)
    return _window_sums(W.fetch(s, ch, SAMPLE_CTX + 1, shards.CHUNK_SIZE, key="i"))


@query("sample_mix", _mix_sql(MIX_COPIES) + f""",
tot AS (SELECT sum(n)::BIGINT AS n FROM m),
idx AS (SELECT range AS i FROM tot, range(0, greatest(1, tot.n // {SAMPLE_CTX + 1}))),
u AS (SELECT i, ({S.md5_int("'mix:" + str(SEED) + ":' || i::VARCHAR")})::DOUBLE / {float(2 ** 60)} AS u FROM idx),
pick AS (SELECT u.i, cw.shard, cw.shard_rank, cw.tokens FROM u JOIN cw
         ON u.u >= (cw.cum - cw.weight) / cw.tot
        AND u.u < (CASE WHEN cw.shard_rank = cw.last THEN 1.0 ELSE cw.cum / cw.tot END)),
s AS (SELECT i, shard,
             ((({S.md5_int(f"({SEED} + shard_rank * {SM.SUBSEED_STEP})::VARCHAR || ':' || shard || ':' || i::VARCHAR")})
               % (tokens - {SAMPLE_CTX})) + i * {SM.STRIDE}) % (tokens - {SAMPLE_CTX}) AS start
      FROM pick)""" + _SAMPLE_AGG)
def q_sample_mix(spark, d):
    ch, meta = _meta(spark, d)
    total = int(meta.agg(F.sum("tokens")).first()[0])
    wts = SM.mix_weights(meta, _shard_list(meta, MIX_COPIES))
    s = SM.mixture_samples(spark, wts, SAMPLE_CTX, SEED, max(1, total // (SAMPLE_CTX + 1)))
    return _window_sums(W.fetch(s, ch, SAMPLE_CTX + 1, shards.CHUNK_SIZE, key="i"))


# --- M5 P18: one smoke batch of each shard ----------------------------------------------------------------------
@query("smoke_batch", _TOK_SQL + f""",
idx AS (SELECT m.shard, m.n, r.range AS i FROM m, range(0, {EVAL_BATCH}) r),
{_STARTS_SQL}
SELECT shard, i::BIGINT AS i, start::BIGINT AS start, true AS valid, {SAMPLE_CTX} AS n_input FROM s""")
def q_smoke_batch(spark, d):
    ch, meta = _meta(spark, d)
    s = SM.shard_samples(meta, SAMPLE_CTX, SEED, num_samples=EVAL_BATCH)
    w = W.with_shift(W.fetch(s, ch, SAMPLE_CTX + 1, shards.CHUNK_SIZE, key="i"), SAMPLE_CTX)
    return w.select("shard", "i", "start", W.valid(SAMPLE_CTX).alias("valid"), F.size("input_ids").alias("n_input"))


# --- A12 A11 W7 P17 --------------------------------------------------------------------------------
def _bigram_sql(max_batches: int | None) -> str:
    cap = "" if max_batches is None else f" AND vp // {BIGRAM_CTX} < {max_batches * EVAL_BATCH}"
    return _TOK_SQL + f""",
sp AS (SELECT shard, CASE WHEN n - greatest(1, floor(n * {TRAIN_FRAC})::BIGINT) < 1 THEN n - 1
                          ELSE greatest(1, floor(n * {TRAIN_FRAC})::BIGINT) END AS k FROM m),
trn AS (SELECT tok.shard, tok.pos, tok.id FROM tok JOIN sp USING (shard) WHERE tok.pos < sp.k),
tp AS (SELECT shard, id AS prev, lead(id) OVER (PARTITION BY shard ORDER BY pos) AS next FROM trn),
pc AS (SELECT shard, prev, next, count(*) AS c FROM tp WHERE next IS NOT NULL GROUP BY ALL),
cc AS (SELECT shard, prev, sum(c) AS cp FROM pc GROUP BY ALL),
val AS (SELECT tok.shard, tok.pos - sp.k AS vp, tok.id FROM tok JOIN sp USING (shard) WHERE tok.pos >= sp.k),
nwin AS (SELECT shard, CASE WHEN count(*) >= {BIGRAM_CTX + 1} THEN (count(*) - {BIGRAM_CTX + 1}) // {BIGRAM_CTX} + 1 ELSE 0 END AS nw
         FROM val GROUP BY shard),
vpairs AS (SELECT shard, vp, id AS prev, lead(id) OVER (PARTITION BY shard ORDER BY vp) AS next FROM val),
scored AS (SELECT shard, vp // {BIGRAM_CTX} AS window_id,
                  -ln((coalesce(pc.c, 0) + 1.0) / (coalesce(cc.cp, 0) + {float(BL.BASE_VOCAB_SIZE)})) AS nll
           FROM vpairs LEFT JOIN pc USING (shard, prev, next) LEFT JOIN cc USING (shard, prev) JOIN nwin USING (shard)
           WHERE vp < nwin.nw * {BIGRAM_CTX}{cap})
SELECT shard || '_val' AS shard, round(sum(nll) / count(*), 6) AS val_loss,
       round(exp(least(sum(nll) / count(*), 100)), 6) AS val_ppl, count(*)::DOUBLE AS val_tokens,
       count(DISTINCT window_id // {EVAL_BATCH})::BIGINT AS n_batches FROM scored GROUP BY shard"""


def split_all(spark, d):
    """Training and validation chunks of every shard."""
    ch, meta = _meta(spark, d)
    counts = shards.split_counts(meta, TRAIN_FRAC)
    return shards.split_parts(materialize(shards.split_chunks(ch, counts), "split_chunks"), counts)


def _bigram(spark, d, max_batches):
    train, val = split_all(spark, d)
    r = EV.evaluate(train, val, shards.shard_meta(val), BIGRAM_CTX, BL.BASE_VOCAB_SIZE, EVAL_BATCH, max_batches, suffix="_val")
    return r.select("shard", F.round("val_loss", 6).alias("val_loss"), F.round("val_ppl", 6).alias("val_ppl"),
                    "val_tokens", "n_batches")


@query("bigram_eval", _bigram_sql(None))
def q_bigram_eval(spark, d):
    return _bigram(spark, d, None)


@query("eval_capped", _bigram_sql(EVAL_MAX_BATCHES))
def q_eval_capped(spark, d):
    return _bigram(spark, d, EVAL_MAX_BATCHES)


# --- M4: loader over each shard, two epochs, drop-last batches -----------------------------------
LOADER_EPOCHS = 2


@query("loader_batches", _TOK_SQL + f""",
lim AS (SELECT shard, n, greatest(1, n // {SAMPLE_CTX + 1}) AS per FROM m),
idx AS (SELECT lim.shard, lim.n, lim.per, (lim.per // {EVAL_BATCH}) * {EVAL_BATCH} AS nfull, r.range AS i
        FROM lim, range(0, lim.per * {LOADER_EPOCHS}) r)
SELECT (i // per)::BIGINT AS epoch, ((i // per) * (nfull // {EVAL_BATCH}) + (i % per) // {EVAL_BATCH})::BIGINT AS batch_id,
       i::BIGINT AS i, shard,
       ((({S.md5_int(f"'{SEED}:' || shard || ':' || i::VARCHAR")}) % (n - {SAMPLE_CTX})) + i * {SM.STRIDE}) % (n - {SAMPLE_CTX}) AS start
FROM idx WHERE i % per < nfull""")
def q_loader_batches(spark, d):
    _, meta = _meta(spark, d)
    return SM.loader_rows(meta, SAMPLE_CTX, EVAL_BATCH, SEED, LOADER_EPOCHS)
