"""Rows with null groups or null order values stay; ids may be text; replayed epochs count once."""

import json
import math
import random
from collections import Counter
from dataclasses import asdict

from pyspark.sql import functions as F

from tessera.operators import evaluate as EV
from tessera.operators import order, sequences, shards
from tessera.operators import sampling as SM
from tessera.operators import windows as W
from tessera.plans import corpus
from tessera.streaming import capped


def test_null_groups_and_orders(spark):
    df = spark.range(300).select(
        F.when(F.col("id") % 7 != 0, (F.col("id") % 3).cast("string")).alias("g"),
        F.when(F.col("id") % 50 != 0, F.col("id")).alias("o"), F.col("id"))
    out = order.with_ordinal(df, ["o", "id"], "n", partition_by=["g"], n_buckets=7).collect()
    assert len(out) == 300
    groups = {}
    for r in out:
        groups.setdefault(r["g"], []).append(r)
    for rows in groups.values():
        rows.sort(key=lambda r: (r["o"] is not None, r["o"] or 0, r["id"]))
        assert [r["n"] for r in rows] == list(range(1, len(rows) + 1))
    low = order.with_running_extreme(df, ["o", "id"], "m", F.col("id"), partition_by=["g"], n_buckets=5)
    assert low.count() == 300
    lag = order.with_lag(df, ["o", "id"], {"p": "id"}, partition_by=["g"], n_buckets=5).collect()
    assert len(lag) == 300 and sum(r["p"] is None for r in lag) == len(groups)


def test_text_order(spark):
    df = spark.range(500).select(F.concat(F.lit("urn:doc:"), F.sha1(F.col("id").cast("string"))).alias("k"))
    out = {r["k"]: r["n"] for r in order.with_ordinal(df, ["k"], "n", n_buckets=9).collect()}
    assert [out[k] for k in sorted(out)] == list(range(1, 501))


def test_replayed_epoch_starts_from_the_one_before(spark, tmpdir_path):
    state_dir = f"{tmpdir_path}/state"
    assert capped._load_state(spark, state_dir, before=0) == capped.CapState()
    for epoch, tokens in ((0, 10), (1, 25)):
        state = json.dumps(asdict(capped.CapState(tokens=tokens)))
        spark.createDataFrame([(epoch, state)], "epoch long, state string").write.json(f"{state_dir}/e={epoch}")
    assert capped._load_state(spark, state_dir).tokens == 25
    assert capped._load_state(spark, state_dir, before=1).tokens == 10
    assert capped._load_state(spark, state_dir, before=0).tokens == 0


def test_listed_shard_must_exist(spark):
    import pytest

    meta = spark.createDataFrame([("a", 10), ("b", 30)], "shard string, tokens long")
    assert SM.mix_weights(meta, ["a", "b", "b"]).count() == 2
    with pytest.raises(ValueError, match="no shard c"):
        SM.mix_weights(meta, ["a", "c"])


def _named(rows, cols):
    """Rows under a null key as they would be under the name that the twin table gives it."""
    return sorted(tuple({None: "n", "<null>_val": "n_val"}.get(r[c], r[c]) if c == "shard" else
                        tuple(r[c]) if isinstance(r[c], list) else r[c] for c in cols) for r in rows)


def test_null_key_gives_what_a_named_key_gives(spark):
    """Every keyed operator over shards null and ``a``, and over ``n`` and ``a`` with the same rows."""
    def chunked(name):
        rows = [(s, k, k * 16, [(k * 7 + j * (3 if s == "a" else 5)) % 11 for j in range(16)]) for s in (name, "a") for k in range(40)]
        return spark.createDataFrame(rows, "shard string, chunk_id long, start long, ids array<int>")

    def results(name):
        ch = chunked(name)
        meta = shards.shard_meta(ch)
        counts = shards.split_counts(meta, 0.9)
        split = shards.split_chunks(ch, counts, chunk_size=16)
        train, val = shards.split_parts(split, counts)
        samples = SM.shard_samples(meta, 8, 3)
        weights = SM.mix_weights(meta, [name, "a", "a"])
        mixed = SM.mixture_samples(spark, weights, 8, 3, 60)
        new = spark.createDataFrame([(name, 1, "int32")], "shard string, tokens long, dtype string")
        values = ch.select("shard", F.col("chunk_id").alias("o"), F.lit(1.5).alias("x"))
        return {
            "meta": meta, "counts": counts, "split": split, "train": train.select("shard", "ids"), "val": val.select("shard", "ids"),
            "windows": W.eval_windows(ch, meta, 8), "epoch": shards.epoch_len(meta, 8), "usage": shards.vocab_usage(ch, 11),
            "fetch": W.fetch(samples.select("shard", "i", F.lit(5).cast("long").alias("start")), ch, 9, 16, key="i"),
            "samples": samples.select("shard", "i"), "loader": SM.loader_rows(meta, 8, 4, 3, 2).select("shard", "i", "batch_id"),
            "weights": weights, "mixed": mixed.select("shard", "i"), "upsert": shards.upsert_meta(meta, new),
            "rolling": sequences.rolling_mean(values, "shard", ["o"], "x", 4),
            "evaluate": EV.evaluate(train, val, shards.shard_meta(val), 8, 11, 2, suffix="_val"),
            "capped": EV.evaluate(train, val, shards.shard_meta(val), 8, 11, 2, 1, suffix="_val"),
            "report": corpus.diagnose(train, val, 8, 11, 2, 1, suffix="_val").select("shard", "capped.val_tokens", "full.val_loss"),
        }
    null, named = results(None), results("n")
    for k in null:
        cols = null[k].columns
        got, want = _named(null[k].collect(), cols), _named(named[k].collect(), cols)
        assert len(got) == len(want) > 0, k
        for g, w in zip(got, want):
            assert all(abs(a - b) < 1e-9 if isinstance(a, float) else a == b for a, b in zip(g, w)), (k, g, w)
    assert {r["rolling"] for r in null["rolling"].collect()} == {1.5}


def test_evaluate_counts_the_pairs_of_its_windows(spark):
    """Pairs straight from the chunks equal those of the windows, for limits inside and on chunk borders."""
    rnd = random.Random(4)
    rows = [("s", k, k * 16, [rnd.randrange(6) for _ in range(16 if k < 9 else 5)]) for k in range(10)]
    ch = spark.createDataFrame(rows, "shard string, chunk_id long, start long, ids array<int>")
    flat = [i for r in rows for i in r[3]]
    pairs = Counter(zip(flat, flat[1:]))
    first = Counter(flat[:-1])
    for ctx, cap in ((8, None), (8, 1), (16, 2), (5, 3), (148, None)):
        n = (len(flat) - ctx - 1) // ctx + 1
        n = n if cap is None else min(n, cap * 2)
        want = [-math.log((pairs[p] + 1) / (first[p[0]] + 6)) for p in list(zip(flat, flat[1:]))[:n * ctx]]
        got = EV.evaluate(ch, ch, shards.shard_meta(ch), ctx, 6, 2, cap).first()
        assert (got.val_tokens, got.n_batches) == (n * ctx, -(-n // 2))
        assert abs(got.val_loss - sum(want) / len(want)) < 1e-9
