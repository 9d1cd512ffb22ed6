"""Streams over several files (several micro-batches) equal their batch twins; results do not
depend on the number of shuffle partitions; the driver contract holds."""
import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tessera.functions import bytelevel as BL
from tessera.operators import bpe, capping, dedupe
from tessera.streaming import capped, epochs
from tessera.streaming.common import table_stream, to_parquet

SF = "/root/testdata/sf0.001"


def _split_files(spark, df, out, n):
    """Write ``df`` as ``n`` parquet files whose names sort in ``doc_id`` order."""
    rows = df.orderBy("doc_id").collect()
    per = (len(rows) + n - 1) // n
    os.makedirs(out, exist_ok=True)
    for i in range(n):
        part = rows[i * per:(i + 1) * per]
        if part:
            spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(os.path.join(out, f"f{i:03d}"))
    return out


def _stream_dir(spark, folder):
    schema = spark.read.parquet(folder + "/f000").schema
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true").parquet(folder))


def test_online_dedupe_equals_batch(spark, tmpdir_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    folder = _split_files(spark, docs, os.path.join(tmpdir_path, "docs"), 4)
    s = _stream_dir(spark, folder).withColumn("ord", F.col("doc_id"))
    got = spark.read.parquet(epochs.online_dedupe(s))
    exp = dedupe.first_per_digest(dedupe.clean(docs.withColumn("ord", F.col("doc_id"))))
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in exp.collect())


def test_capped_stream_equals_batch(spark, tmpdir_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    folder = _split_files(spark, docs, os.path.join(tmpdir_path, "cap"), 5)
    passed = F.col("lang") == "en"
    n_tok = F.octet_length("text") + 1
    total = docs.where(passed).agg(F.sum(n_tok)).first()[0]
    cap = int(total) // 3
    batch = capping.capped_prefix(docs, "doc_id", passed, n_tok, cap, 4).stats.first()
    s = _stream_dir(spark, folder)
    out, state, progress = capped.stream_capped(s, "doc_id", "text", passed, BL.byte_pieces, cap, 4, "en", name="t_cap")
    assert (state.seen, state.kept, state.dropped, state.tokens) == \
        (batch.docs_seen, batch.docs_kept, batch.docs_dropped, batch.tokens)
    assert len(progress.rows) >= 1 and progress.rows[-1]["tokens"] == cap
    assert spark.read.parquet(out).agg(F.sum(F.size("ids"))).first()[0] == cap


def test_quota_stream_across_batches(spark, tmpdir_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_id").alias("doc_id"), "user_id", "ts")
    folder = _split_files(spark, ev, os.path.join(tmpdir_path, "ev"), 3)
    s = _stream_dir(spark, folder)
    got = spark.read.parquet(epochs.quota(s, "user_id", "ts", "doc_id", 5))
    acc = {r.doc_id: r.accepted for r in got.collect()}
    rows = ev.orderBy("user_id", "ts", "doc_id").collect()
    seen = {}
    for r in rows:
        seen[r.user_id] = seen.get(r.user_id, 0) + 1
        assert acc[r.doc_id] == (seen[r.user_id] <= 5)


@pytest.mark.parametrize("name", ["clean_dedupe", "doc_order", "token_cap_prefix", "chunk_stats",
                                  "running_best", "rolling_entropy", "chat_truncated"])
def test_partition_count_independence(spark, name):
    q = E.queries()[name]
    results = []
    for parts in (1, 4, 13):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        df = q(spark, SF)
        results.append(sorted(tuple(str(x) for x in r) for r in df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1] == results[2]


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.columns == ["doc_id", "source", "sha1", "text"] and df.count() > 0
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)


def test_capped_stream_resumes_from_checkpoint(spark, tmpdir_path):
    import shutil
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    staged = _split_files(spark, docs, os.path.join(tmpdir_path, "staged"), 4)
    live = os.path.join(tmpdir_path, "live")
    os.makedirs(live)
    passed = F.col("lang") == "en"
    n_tok = F.octet_length("text") + 1
    cap = int(docs.where(passed).agg(F.sum(n_tok)).first()[0]) * 3 // 4
    batch = capping.capped_prefix(docs, "doc_id", passed, n_tok, cap, 4).stats.first()
    ckpt = os.path.join(tmpdir_path, "ckpt")
    for part in ("f000", "f001"):
        shutil.copytree(os.path.join(staged, part), os.path.join(live, part))
    capped.stream_capped(_stream_dir(spark, live), "doc_id", "text", passed, BL.byte_pieces, cap, 4, "en", checkpoint=ckpt)
    for part in ("f002", "f003"):
        shutil.copytree(os.path.join(staged, part), os.path.join(live, part))
    out, state, _ = capped.stream_capped(_stream_dir(spark, live), "doc_id", "text", passed, BL.byte_pieces, cap, 4,
                                         "en", checkpoint=ckpt)
    assert (state.seen, state.kept, state.tokens) == (batch.docs_seen, batch.docs_kept, batch.tokens)
    assert spark.read.parquet(out).agg(F.sum(F.size("ids"))).first()[0] == batch.tokens


def test_progress_listener_sees_observed_metrics(spark, tmpdir_path):
    from tessera.streaming.common import ProgressListener
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    folder = _split_files(spark, docs, os.path.join(tmpdir_path, "obs"), 3)
    s = _stream_dir(spark, folder).observe(
        "progress", F.count(F.lit(1)).alias("seen"), F.count(F.when(F.col("lang") == "en", 1)).alias("kept"))
    lst = ProgressListener(spark, "progress")
    try:
        to_parquet(s.select("doc_id"), "t_obs")
        lst.wait()
    finally:
        lst.close()
    assert sum(r["seen"] for r in lst.rows) == docs.count()
    assert sum(r["kept"] for r in lst.rows) == docs.where(F.col("lang") == "en").count()


def test_continuous_trigger_ends_at_the_cap(spark, tmpdir_path):
    """A trained vocabulary, a trigger without an end, a cap inside the second of six files: the
    query stops by itself, later files are not read, and the tokens are those of the batch build."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    folder = _split_files(spark, docs, os.path.join(tmpdir_path, "cont"), 6)
    model = bpe.train(bpe.word_counts(docs.select("text")), vocab_size=400)
    passed = F.col("lang") == "en"
    whole = bpe.encode_pieces(docs.where(passed).select(F.lit("en").alias("shard"), F.col("doc_id").alias("ord"), "text"), model)
    ids = {}
    for r in whole.orderBy("ord", "piece").collect():
        ids.setdefault(r.ord, []).extend(r.ids)
    flat = [i for k in sorted(ids) for i in ids[k]]
    cap = len(flat) // 5
    out, state, progress = capped.stream_capped(
        _stream_dir(spark, folder), "doc_id", "text", passed, lambda d: bpe.encode_pieces(d, model), cap, 4, "en",
        name="t_cont", trigger={"processingTime": "100 milliseconds"})
    assert state.done and state.tokens == cap and not spark.streams.active
    assert len(progress.rows) < 6
    got = [i for r in spark.read.parquet(out).orderBy("start").collect() for i in r.ids]
    assert got == flat[:cap]


def test_dedupe_epoch_that_runs_again(spark, tmpdir_path):
    """A commit that was lost: the epoch's rows are written over, none is kept twice or dropped."""
    docs = spark.createDataFrame([(k, f"text {k % 7}", k) for k in range(20)], "doc_id long, text string, ord long")
    folder = _split_files(spark, docs, os.path.join(tmpdir_path, "again"), 4)
    ckpt = os.path.join(tmpdir_path, "ckpt")
    epochs.online_dedupe(_stream_dir(spark, folder), checkpoint=ckpt)
    os.remove(os.path.join(ckpt, "commits", "3"))
    crc = os.path.join(ckpt, "commits", ".3.crc")
    os.path.exists(crc) and os.remove(crc)
    out = epochs.online_dedupe(_stream_dir(spark, folder), checkpoint=ckpt)
    assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == list(range(7))


def test_dedupe_horizon(spark, tmpdir_path):
    docs = spark.createDataFrame([(k, "same" if k % 5 == 0 else f"t{k}", k) for k in range(20)], "doc_id long, text string, ord long")
    folder = _split_files(spark, docs, os.path.join(tmpdir_path, "hor"), 4)
    kept = spark.read.parquet(epochs.online_dedupe(_stream_dir(spark, folder), horizon=1)).where("text = 'same'")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 10]  # epoch 1 sees epoch 0, epoch 2 sees a survivor-less epoch 1


def test_quota_snapshots_and_null_key(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(epochs, "SNAPSHOT_EVERY", 2)
    rows = [(k, None if k % 3 == 0 else k % 3, k) for k in range(60)]
    ev = spark.createDataFrame(rows, "doc_id long, user long, s long").select("doc_id", "user", F.timestamp_seconds("s").alias("ts"))
    folder = _split_files(spark, ev, os.path.join(tmpdir_path, "q"), 6)
    got = {r.doc_id: r.accepted for r in spark.read.parquet(epochs.quota(_stream_dir(spark, folder), "user", "ts", "doc_id", 12)).collect()}
    assert got == {k: k // 3 < 12 for k in range(60)}


def test_diagnostics_over_epochs_and_blocks(spark, tmpdir_path):
    """Sequences that go on over several epochs, one of them null and longer than a block."""
    import random
    rnd, rows = random.Random(4), []
    for key, n in ((None, 400), ("a", 150), ("b", 2)):
        rows += [(key, k, rnd.randrange(3), rnd.random()) for k in range(n)]
    rows.sort(key=lambda r: r[1])
    df = spark.createDataFrame(rows, "seq string, pos long, tok long, ent double")
    for k in range(4):  # a quarter of each sequence in each file
        df.where(F.floor(F.col("pos") / 100) == k).coalesce(1).write.mode("append").parquet(tmpdir_path + "/in")
        time.sleep(0.05)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(tmpdir_path + "/in")
    out = epochs.diagnostics(stream, "seq", "pos", "tok", "ent", 3, 20, 64, block_rows=50)
    got = {(r.seq, r.pos): (round(r.avg_entropy, 9), r.repeated) for r in spark.read.parquet(out).collect()}
    want = {}
    for key in (None, "a", "b"):
        toks, ents = [r[2] for r in rows if r[0] == key], [r[3] for r in rows if r[0] == key]
        for i in range(len(toks)):
            mean = sum(ents[max(0, i - 19):i + 1]) / min(20, i + 1)
            window = toks[max(0, i - 63):i + 1]
            hit = any(window[j:j + 3] == window[-3:] for j in range(len(window) - 3))
            want[key, i] = (round(mean, 9), hit)
    assert got == want
