"""Shards, split, windows, mixtures and evaluation (reference expectations)."""
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate as EV
from tessera.operators import sampling as SM
from tessera.operators import shards
from tessera.operators import windows as W
from tessera.sources import textfiles, tokenbin


def _stream(spark, shard, ids, chunk=7):
    pieces = spark.createDataFrame([(shard, 0, ids)], "shard string, start bigint, ids array<int>")
    return shards.to_chunks(pieces, chunk)


def _flat(chunks, shard):
    rows = chunks.where(F.col("shard") == shard).orderBy("chunk_id").collect()
    return [x for r in rows for x in r.ids]


def test_append_pieces(spark):
    p = spark.createDataFrame([("s", 0, [1, 2, 3]), ("s", 3, [4, 5])], "shard string, start bigint, ids array<int>")
    assert _flat(shards.to_chunks(p, 2), "s") == [1, 2, 3, 4, 5]


def test_pack_offsets_with_eos(spark):
    docs = spark.createDataFrame([("s", 1, [ord(c) % 100 for c in "hello"] + [0]),
                                  ("s", 2, [ord(c) % 100 for c in "world"] + [0])],
                                 "shard string, ord long, ids array<int>")
    packed = shards.pack_offsets(docs).orderBy("ord").collect()
    assert [r.start for r in packed] == [0, 6]
    flat = _flat(shards.to_chunks(shards.pack_offsets(docs), 4), "s")
    assert len(flat) == 12 and flat[5] == 0 and flat[11] == 0   # EOS closes each document


@pytest.mark.parametrize("n,train,val", [(100, 95, 5), (1000, 950, 50), (2, 1, 1)])
def test_split_prefix_suffix(spark, n, train, val):
    ch = _stream(spark, "w", list(range(n)))
    meta = shards.shard_meta(ch)
    counts = shards.split_counts(meta, 0.95)
    c = counts.first()
    assert (c.train_tokens, c.val_tokens) == (train, val)
    sp = shards.split_chunks(ch, counts, chunk_size=7)
    assert _flat(sp, "w") == list(range(train)) and _flat(sp, "w_val") == list(range(train, n))
    m = {r.shard: r.tokens for r in shards.upsert_meta(meta, shards.shard_meta(sp)).collect()}
    assert m == {"w": train, "w_val": val}


def test_split_rejects_bad_fraction(spark):
    with pytest.raises(ValueError):
        shards.split_counts(shards.shard_meta(_stream(spark, "w", [1, 2, 3])), 1.0)


def test_window_shift(spark):
    ch = _stream(spark, "s", list(range(5000)), chunk=97)
    meta = shards.shard_meta(ch).first().asDict()
    s = SM.single_shard_samples(spark, meta, 128, 42, num_samples=4)
    w = W.with_shift(W.fetch(s, ch, 129, 97, key="i"), 128).collect()
    assert len(w) == 4
    for r in w:
        assert len(r.input_ids) == 128 and len(r.labels) == 128
        assert list(r.labels[:-1]) == list(r.input_ids[1:])
        assert list(r.input_ids) == list(range(r.start, r.start + 128))


def test_too_short(spark):
    with pytest.raises(ValueError, match="too few tokens"):
        SM.single_shard_samples(spark, {"shard": "s", "tokens": 10}, 32, 42)


def test_mixture_weights_and_share(spark):
    big = _stream(spark, "big", list(range(4000)), chunk=256)
    small = _stream(spark, "small", list(range(10000, 11000)), chunk=256)
    ch = big.unionByName(small)
    meta = shards.shard_meta(ch)
    wts = SM.mix_weights(meta, ["big", "small"])
    p = {r.shard: r.p for r in wts.collect()}
    assert p == {"big": 0.8, "small": 0.2}
    s = SM.mixture_samples(spark, wts, 16, 42, 800)
    share = s.where(F.col("shard") == "big").count() / 800
    assert abs(share - 0.8) < 0.08
    w = W.fetch(s, ch, 17, 256, key="i")
    rows = w.collect()
    assert all((r.w[0] < 10000) == (r.shard == "big") for r in rows)


def test_reseed(spark):
    meta = {"shard": "s", "tokens": 5000}
    a = [r.start for r in SM.single_shard_samples(spark, meta, 16, 1, 24).orderBy("i").collect()]
    b = [r.start for r in SM.single_shard_samples(spark, meta, 16, 1, 24).orderBy("i").collect()]
    c = [r.start for r in SM.single_shard_samples(spark, meta, 16, 2, 24).orderBy("i").collect()]
    assert a == b and a != c


def test_eval_capped_vs_full(spark):
    import random
    rnd = random.Random(0)
    ids = [rnd.randrange(64) for _ in range(500)]
    val = _stream(spark, "v", ids, chunk=50)
    train = _stream(spark, "t", [rnd.randrange(64) for _ in range(2000)], chunk=50)
    meta = shards.shard_meta(val)
    full = EV.evaluate(train, val, meta, 16, 64, 4, None).first()
    capped = EV.evaluate(train, val, meta, 16, 64, 4, 5).first()
    assert full.val_loss > 0 and full.val_ppl > 1
    assert (full.val_tokens, capped.val_tokens) == (496.0, 320.0)


def test_eval_windows_count(spark):
    ch = _stream(spark, "s", list(range(30)), chunk=4)
    w = W.eval_windows(ch, shards.shard_meta(ch), 6).orderBy("window_id").collect()
    assert [r.start for r in w] == [0, 6, 12, 18] and all(list(r.w) == list(range(r.start, r.start + 7)) for r in w)


def test_bin_parts(spark, tmpdir_path):
    ch = _stream(spark, "s", list(range(1000)), chunk=64)
    target = "file:" + os.path.join(tmpdir_path, "a b", "s.bin")
    tokenbin.write_parts(ch.repartition(3), target)
    with pytest.raises(FileExistsError):
        tokenbin.write_parts(ch, target)
    for size in (64, 48, 5000):  # other chunks than those written as well
        assert _flat(tokenbin.read_bin(spark, target, chunk_size=size), "s") == list(range(1000))
    m = tokenbin.meta_from_files(spark, {"s": target, "missing": target + ".nope"}).collect()
    assert [(r.shard, r.tokens) for r in m] == [("s", 1000)]
    folder = target.removeprefix("file:")
    parts = sorted(x for x in os.listdir(folder) if x.startswith("part-") and x.endswith(".bin"))
    flat = b"".join(open(os.path.join(folder, x), "rb").read() for x in parts)
    assert flat == b"".join(k.to_bytes(4, "little") for k in range(1000))
    empty = target + ".empty"
    tokenbin.write_parts(ch.where("false"), empty)
    assert tokenbin.read_bin(spark, empty).count() == 0


def test_checksum_of_a_file_beyond_one_row(spark, tmpdir_path):
    path, size = os.path.join(tmpdir_path, "large file.bin"), (1 << 31) + 5
    with open(path, "wb") as f:
        f.truncate(size)
    digest = hashlib.sha256()
    for _ in range(size >> 20):
        digest.update(bytes(1 << 20))
    digest.update(bytes(size % (1 << 20)))
    row = textfiles.file_checksums(spark, path).first()
    assert (row["bytes"], row["sha256"]) == (size, digest.hexdigest())


def test_bin_roundtrip(spark, tmpdir_path):
    ch = _stream(spark, "s", list(range(1000)), chunk=64)
    target = os.path.join(tmpdir_path, "s.bin")
    tokenbin.write_bin(ch.repartition(3), target)
    assert os.path.getsize(target) == 4000
    with pytest.raises(FileExistsError):
        tokenbin.write_bin(ch, target)
    back = tokenbin.read_bin(spark, target, chunk_size=64)
    assert _flat(back, "s") == list(range(1000))
    m = tokenbin.meta_from_files(spark, {"s": target, "missing": target + ".nope"}).collect()
    assert [(r.shard, r.tokens) for r in m] == [("s", 1000)]


def _exchanges_of_ids(df) -> list[str]:
    """The shuffles of the plan that hold whole chunks."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("\n") if "Exchange hashpartitioning(coalesce(shard" in x]


def test_a_split_does_not_shuffle_the_chunks_by_shard(spark):
    from tessera.operators.materialize import materialize
    ch = materialize(spark.createDataFrame([(s, k, k * 8, list(range(k, k + 8))) for s in ("a", "b") for k in range(50)],
                                           "shard string, chunk_id long, start long, ids array<int>"), "t_split")
    size, conf = "spark.sql.autoBroadcastJoinThreshold", spark.conf
    old = conf.get(size)
    conf.set(size, "1")  # as with tables above the threshold: an aggregate is estimated by its input's size
    try:
        counts = shards.split_counts(shards.shard_meta(ch), 0.9)
        split = shards.split_chunks(ch, counts, chunk_size=8)
        assert not _exchanges_of_ids(split)
        train, val = shards.split_parts(split, counts)
        assert not _exchanges_of_ids(train) and not _exchanges_of_ids(val)
        assert {r.shard: r.tokens for r in shards.shard_meta(val).collect()} == {"a_val": 40, "b_val": 40}
    finally:
        conf.set(size, old)


def test_many_windows_are_never_broadcast_and_are_sliced_from_one_row(spark, monkeypatch):
    from pyspark.sql import functions as F
    from tessera.operators import sampling as SM
    from tessera.operators.materialize import materialize
    ids = {s: [(7 * k + len(s or "")) % 251 for k in range(3000)] for s in ("a", None)}
    ch = materialize(shards.to_chunks(spark.createDataFrame([(s, 0, v) for s, v in ids.items()],
                                                            "shard string, start bigint, ids array<int>"), 16), "t_fetch")
    meta = materialize(shards.shard_meta(ch), "t_meta")
    monkeypatch.setattr(W, "FEW_WINDOWS", 10)
    for width in (1, 9, 17, 50):  # in one chunk, over two, over several
        s = SM.shard_samples(meta, width, 42).withColumn("start", F.least(F.col("start"), F.lit(3000 - width)))
        got = W.fetch(s, ch, width, 16, key="i")
        rows = got.collect()
        assert len(rows) == 2 * (3000 // (width + 1))
        assert all(r.w == ids[r.shard][r.start:r.start + width] for r in rows)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" not in plan and "strategy=merge" in plan
