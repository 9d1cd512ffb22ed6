"""Shard write/append, manifests, vocabulary files, JSONL export, ordered concatenation, X1."""
import json
import os

from pyspark.sql import functions as F

from tessera.operators import bpe, chat, runs, shards
from tessera.sources import artifacts, textfiles


def _flat(chunks, shard):
    return [x for r in chunks.where(F.col("shard") == shard).orderBy("chunk_id").collect() for x in r.ids]


def test_append_tokens_continues_shard(spark):
    p = spark.createDataFrame([("s", 0, [1, 2, 3])], "shard string, start bigint, ids array<int>")
    ch = shards.to_chunks(p, 2)
    meta = shards.shard_meta(ch)
    new = spark.createDataFrame([("s", 1, [4, 5]), ("t", 1, [9])], "shard string, ord long, ids array<int>")
    out = artifacts.append_tokens(ch, meta, new, 2)
    assert _flat(out, "s") == [1, 2, 3, 4, 5] and _flat(out, "t") == [9]
    assert {r.shard: r.tokens for r in shards.shard_meta(out).collect()} == {"s": 5, "t": 1}


def test_write_shards_and_meta_roundtrip(spark, tmpdir_path):
    p = spark.createDataFrame([("a", 0, list(range(10))), ("b", 0, [7, 8])], "shard string, start bigint, ids array<int>")
    ch = shards.to_chunks(p, 4)
    path = os.path.join(tmpdir_path, "tok")
    artifacts.write_shards(ch, path)
    back = spark.read.parquet(path)
    assert _flat(back, "a") == list(range(10))
    mp = os.path.join(tmpdir_path, "meta")
    assert artifacts.load_meta(spark, mp).count() == 0
    artifacts.save_meta(shards.shard_meta(ch), mp)
    assert {(r.shard, r.tokens, r.dtype) for r in artifacts.load_meta(spark, mp).collect()} == \
        {("a", 10, "int32"), ("b", 2, "int32")}


def test_vocab_files_roundtrip(spark, tmpdir_path):
    df = spark.createDataFrame([("aaab aaab aaab abab abab",)] * 3, "text string")
    m = bpe.train(bpe.word_counts(df), vocab_size=264)
    out = os.path.join(tmpdir_path, "vocab")
    artifacts.save_vocab(m, out)
    vocab, merges = artifacts.load_vocab(spark, out)
    assert {r.token: r.id for r in vocab.collect()} == {r.token: r.id for r in m.vocab.collect()}
    assert [(r.rank, r.left, r.right, r.id) for r in merges.orderBy("rank").collect()] == \
        [(r.rank, r.left, r.right, r.id) for r in m.merges.orderBy("rank").collect()]


def test_jsonl_export(spark, tmpdir_path):
    rec = spark.createDataFrame([(1, '{"a":"é"}')], "conv_id long, json string")
    out = os.path.join(tmpdir_path, "jsonl")
    artifacts.export_jsonl(rec, out)
    lines = [l for f in os.listdir(out) if f.startswith("part-") for l in open(os.path.join(out, f), encoding="utf-8")]
    assert [json.loads(l) for l in lines] == [{"a": "é"}]


def test_concat_ranks_inputs(spark):
    a = spark.createDataFrame([("x",)], "text string")
    b = spark.createDataFrame([("y",)], "text string")
    assert sorted((r.src_rank, r.text) for r in artifacts.concat([a, b]).collect()) == [(0, "x"), (1, "y")]


def test_ingest_manifest(spark, tmpdir_path):
    src = spark.createDataFrame([(1, "Story one."), (2, "Story two."), (3, "")], "id long, text string")
    m = artifacts.ingest(src, os.path.join(tmpdir_path, "ing"), ord_col="id").first()
    assert (m.lines, m.empty_skipped) == (2, 1)


def test_pluggable_encoder(spark):
    docs = spark.createDataFrame([(1, "hello"), (2, "world")], "doc_id long, text string")
    enc = bpe.encode_with(docs, lambda texts: [[ord(c) % 100 for c in t] for t in texts], eos_id=0)
    got = {r.doc_id: list(r.ids) for r in enc.collect()}
    assert got[1] == [4, 1, 8, 8, 11, 0] and got[2][-1] == 0


def test_read_lines_order_across_files(spark, tmpdir_path):
    paths = []
    for k in range(3):
        p = os.path.join(tmpdir_path, f"f{k}.txt")
        with open(p, "w") as f:
            f.write("".join(f"{k}-{i}\n" for i in range(50)))
        paths.append(p)
    rows = textfiles.read_lines(spark, paths).orderBy("ord").collect()
    assert [r.text for r in rows] == [f"{k}-{i}" for k in range(3) for i in range(50)]


def test_latest_status_follows_the_log_not_the_step(spark):
    rows = spark.createDataFrame([("a", 1, 10, 2.0), ("a", 2, 20, 1.0), ("a", 3, 15, None), ("a", 4, None, 1.5), ("b", 1, 3, 4.0)],
                                 "run string, line int, step long, loss double")
    got = {r.run: (r.last_step, r.last_loss) for r in runs.latest_status(rows, order="line").collect()}
    assert got == {"a": (15, 1.5), "b": (3, 4.0)}


def test_request_keeps_explicit_nulls(spark):
    bodies = [(0, '{"messages":[{"role":"user","content":"x"}]}'), (1, '{"messages":[],"temperature":null,"stream":true}'),
              (2, "not json")]
    df = spark.createDataFrame(bodies, "i int, js string").select("i", chat.parse_request(F.col("js")).alias("r"))
    got = {x.i: (x.r.temperature, x.r.stream, x.r.valid) for x in df.collect()}
    assert got == {0: (0.8, False, True), 1: (None, True, False), 2: (0.8, False, False)}


def test_legacy_request(spark):
    bodies = [(0, '{"prompt":"hi"}'), (1, '{"prompt":null,"max_tokens":null,"stop":["a"]}'), (2, '{"max_tokens":3,"seed":9}'),
              (3, "not json"), (4, None)]
    df = spark.createDataFrame(bodies, "i int, js string").select("i", chat.parse_legacy(F.col("js")).alias("r"))
    got = {x.i: (x.r.prompt, x.r.max_tokens, x.r.stop, x.r.seed) for x in df.collect()}
    assert got == {0: ("hi", 128, [], None), 1: (None, None, ["a"], None), 2: ("", 3, [], 9), 3: ("", 128, [], None),
                   4: ("", 128, [], None)}


def test_request_rejects(spark):
    bodies = {'{"messages":[{"role":"user","content":"x"}]}': None, "{": "malformed body", None: "malformed body",
              "[1]": "not an object", "3": "not an object", "{}": "no messages", '{"messages":null}': "no messages",
              '{"messages":[]}': "no messages", '{"messages":"x"}': "messages not a list",
              '{"messages":{"role":"user"}}': "messages not a list",
              '{"messages":[{"role":"user"},{"content":"x"}]}': "message without a role", '{"messages":[4]}': "message without a role"}
    df = spark.createDataFrame([(b,) for b in bodies], "json string")
    got = {r["json"]: r["reason"] for r in chat.rejects(df).collect()}
    assert got == {b: reason for b, reason in bodies.items() if reason}


def test_single_turn_and_responses(spark):
    one = spark.createDataFrame([("hi", "be kind"), ("hi", None), (None, "")], "p string, s string")
    got = [r[0] for r in one.select(chat.single_turn_context(F.col("p"), F.col("s"))).collect()]
    assert got == ["System: be kind\nUser: hi\nAssistant:", "User: hi\nAssistant:", "User: \nAssistant:"]
    conv = spark.createDataFrame([(1, 0, "user", "a b"), (1, 1, "assistant", "c"), (1, 2, "user", None), (1, 3, "assistant", "d e f"),
                                  (1, 4, "user", "later"), (2, 0, "user", "no reply"), (3, 0, "assistant", None)],
                                 "conv_id long, turn int, role string, text string")
    out = {r["conv_id"]: json.loads(r["json"]) for r in chat.response_records(conv).collect()}
    assert set(out) == {1, 3}
    assert out[1]["choices"][0]["message"] == {"role": "assistant", "content": "d e f"}
    assert out[1]["usage"] == {"prompt_tokens": 3, "completion_tokens": 3, "total_tokens": 6}
    assert out[3]["usage"]["total_tokens"] == 0 and out[3]["choices"][0]["text"] == ""


def test_retention_over_a_listing(spark, tmpdir_path):
    names = ["step_5.pt", "step_40.pt", "step_300.pt", "step_7.pt.tmp", "best.pt", "step_x.pt", "my_step_9.pt"]
    rows = [(run, n, "x" * k) for run in ("a", "b") for k, n in enumerate(names, 1)]
    spark.createDataFrame(rows, "run string, name string, value string").write.partitionBy("run", "name").text(tmpdir_path + "/r")
    glob = tmpdir_path + "/r/run=*/name=*/part-*"

    def steps():
        return sorted((r["folder"][-7:-6], r["step"]) for r in runs.listed_artifacts(spark, glob).collect())
    assert steps() == [(r, s) for r in "ab" for s in (5, 40, 300)]
    for n, left in ((2, [40, 300]), (2, [40, 300]), (0, [])):
        plan = runs.prune_plan(runs.listed_artifacts(spark, glob), n)
        plan = spark.createDataFrame(plan.collect(), plan.schema)
        assert sum(not r["keep"] for r in plan.collect()) == runs.apply_prune(plan)
        assert steps() == [(r, s) for r in "ab" for s in left]
        assert runs.apply_prune(plan) == 0
    others = spark.read.format("binaryFile").load(glob).select("path").count()
    assert others == 2 * 4
