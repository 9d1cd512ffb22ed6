"""Chat layout, stop strings, logit filters, retention, rate limits (reference expectations)."""
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import chat as C
from tessera.operators import ratelimit as RL
from tessera.operators import runs as R
from tessera.operators import scores as SC
from tessera.operators import sequences as SQ


def _conv(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_empty_history_layout(spark):
    c = _conv(spark, [(1, 0, "system", "hi")])
    assert C.repl_context(c).first().context == "System: hi\nAssistant:"


def test_two_turn_layout(spark):
    c = _conv(spark, [(1, 0, "user", "hello"), (1, 1, "assistant", "world")])
    ctx = C.repl_context(c, default_system="sys").first().context
    assert ctx == "System: sys\nUser: hello\nAssistant: world\nAssistant:"


def test_truncation_drops_oldest_and_fits(spark):
    words = " ".join(["w"] * 15)
    c = _conv(spark, [(1, i, "user" if i % 2 == 0 else "assistant", words) for i in range(4)])
    r = C.truncated_context(c, 40, default_system="s").first()
    assert r.n_tokens <= 40 and r.kept_messages == 2
    assert r.context.endswith("Assistant: " + words + "\nAssistant:")


def test_pairing_variants(spark):
    rows = [(1, 0, "system", "first"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"),
            (1, 3, "system", "last"), (1, 4, "user", "u2")]
    c = _conv(spark, rows)
    last = C.paired_context(c, "last", False).first().context
    first = C.paired_context(c, "first", True).first().context
    assert last == "System: last\nUser: u1\nAssistant: a1\nAssistant:"
    assert first == "System: first\nUser: u1\nAssistant: a1\nUser: u2\nAssistant:"


def test_stop_strings(spark):
    df = spark.createDataFrame([("once upon the time",), ("no stop here",), ("xxab",)], "t string")
    cut, idx = C.stop_cut(F.col("t"), ["the", "", "ab", "b"])
    got = [(r.c, r.i) for r in df.select(cut.alias("c"), idx.alias("i")).collect()]
    assert got == [("once upon ", 0), ("no stop here", None), ("xx", 2)]


def test_request_defaults(spark):
    df = spark.createDataFrame([('{"messages":[{"role":"user","content":"hi"}]}',), ('{"messages":[]}',)], "j string")
    r = df.select(C.parse_request(F.col("j")).alias("r")).collect()
    assert r[0].r.temperature == 0.8 and r[0].r.stream is False and r[0].r.max_tokens == 128 and r[0].r.valid
    assert not r[1].r.valid


def test_topk_keeps_ties_and_argmax_first(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0, 2.0, 3.0],)], "l array<float>")
    r = df.select(F.size(F.filter(SC.top_k_mask(F.col("l"), 2), lambda b: b)).alias("n"),
                  SC.argmax(F.col("l")).alias("a")).first()
    assert r.n == 3 and r.a == 1


def test_nucleus_first_always_kept(spark):
    df = spark.createDataFrame([([10.0, 0.0, 0.0],)], "l array<float>")
    p = SC.with_filtered_probs(df, "l", "p", 1.0, None, 0.1).first().p
    assert p[0] == 1.0 and p[1] is None and p[2] is None


def test_draw_reproducible(spark):
    df = spark.createDataFrame([(i, [float(j % 7) for j in range(32)]) for i in range(50)], "i long, l array<float>")
    p = SC.with_filtered_probs(df, "l", "p", 0.8, 10, 0.9)
    a = [r.t for r in p.select(SC.draw(F.col("p"), F.lit("s"), F.col("i").cast("string")).alias("t")).orderBy("i").collect()]
    b = [r.t for r in p.select(SC.draw(F.col("p"), F.lit("s"), F.col("i").cast("string")).alias("t")).orderBy("i").collect()]
    assert a == b and len(set(a)) > 1


def test_retention_keeps_last_three(spark):
    df = spark.createDataFrame([("r", s, f"step_{s}.pt") for s in range(1, 6)], "run string, step long, path string")
    assert sorted(r.step for r in R.keep_last(df, 3).collect()) == [3, 4, 5]
    assert R.keep_last(df, 0).count() == 0


def test_log_parse_anchored(spark):
    df = spark.createDataFrame([("step=3 loss=2.5 step 7 val_loss=9.0",)], "l string")
    step, loss = R.parse_log_line(F.col("l"))
    loose = R.parse_log_line(F.col("l"), anchored=False)[1]
    r = df.select(step.alias("s"), loss.alias("x"), loose.alias("y")).first()
    assert (r.s, r.x, r.y) == (7, 2.5, 9.0)


def test_sliding_window_matches_python(spark):
    rnd = random.Random(3)
    rows, eid = [], 0
    for user in range(6):
        t = 0.0
        for _ in range(rnd.randrange(5, 120)):
            t += rnd.choice([0.5, 1.0, 5.0, 30.0, 61.0, 300.0])
            rows.append((eid, user, t))
            eid += 1
    df = spark.createDataFrame(rows, "event_id long, user_id long, t double") \
        .withColumn("ts", F.timestamp_seconds("t"))
    got = {r.event_id: r.accepted for r in RL.sliding_window(df, "user_id", "ts", "event_id", 3).collect()}
    for user in range(6):
        ev = [(e, t) for e, u, t in rows if u == user]
        exp = RL.sliding_window_reference([t for _, t in ev], 3)
        assert [got[e] for e, _ in ev] == exp


@pytest.mark.parametrize("step,rate", [([0.25], 20), ([0.0, 0.5, 7.0, 59.0], 3), ([1.0, 2.0, 20.0], 1)])
def test_busy_key_in_chunks(spark, step, rate):
    """One key without gaps, in chunks of 16 events: saturated bursts that never fall into step as well."""
    rnd, t, times = random.Random(5), 0.0, []
    for _ in range(900):
        t += rnd.choice(step)
        times.append(t)
    rows = [(k, None, x) for k, x in enumerate(times)] + [(k + 900, 1, x) for k, x in enumerate(times[:70])] + [(2000, 1, None)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, t double").withColumn("ts", F.timestamp_seconds("t"))
    out = RL.sliding_window(df, "user_id", "ts", "event_id", rate, chunk_rows=16)
    got = {r.event_id: r.accepted for r in out.collect()}
    assert [got[k] for k in range(900)] == RL.sliding_window_reference(times, rate)
    assert [got[k + 900] for k in range(70)] == RL.sliding_window_reference(times[:70], rate)
    assert got[2000] is False and len(got) == len(rows)


def test_ngram_repeats(spark):
    rnd = random.Random(2)
    rows = [(k, [rnd.choice(["a", "b", None, "c"]) for _ in range(n)]) for k, n in enumerate([0, 1, 2, 3, 40, 300])] + [(9, None)]
    out = SQ.ngram_repeats(spark.createDataFrame(rows, "k long, w array<string>"), "k", "w", 3, 16)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = {(k, i, any(w[j:j + 3] == w[i:i + 3] for j in range(max(0, i - 13), i)))
            for k, w in rows if w for i in range(len(w) - 2)}
    assert {tuple(r) for r in out.collect()} == want


def test_fit_context_keeps_tail_and_budget(spark):
    df = spark.createDataFrame([(list(range(10)),), (list(range(3)),)], "ids array<int>")
    kept, budget = C.fit_context(F.col("ids"), 5, 4)
    rows = df.select(kept.alias("k"), budget.alias("b")).collect()
    assert list(rows[0].k) == [6, 7, 8, 9] and rows[0].b == 1
    assert list(rows[1].k) == [0, 1, 2] and rows[1].b == 2
