"""BPE training / encode / decode against the tokenizers library on the reference's fixture."""
import json
import os
import random

import pytest

from tessera.functions import bytelevel as BL
from tessera.operators import bpe, bpe_train

LINES = ([f"The quick brown fox jumps over the lazy dog number {i}." for i in range(200)]
         + [f"Once upon a time there was a little robot named item {i}." for i in range(200)])


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame([(t,) for t in LINES], "text string")
    return bpe.train(bpe.word_counts(df), vocab_size=500, min_frequency=2)


def test_base_alphabet():
    assert len(BL.BYTE_CHARS) == 256 and len(set(BL.BYTE_CHARS)) == 256
    assert sorted(BL.BASE_IDS) == list(range(4, 260))
    assert BL.BASE_IDS[ord("!")] == 4 and BL.BASE_IDS[0] == 192 and BL.BASE_IDS[173] == 259


def test_matches_library(spark, model, tmpdir_path):
    tokenizers = pytest.importorskip("tokenizers")
    p = os.path.join(tmpdir_path, "c.txt")
    with open(p, "w") as f:
        f.write("\n".join(LINES) + "\n")
    tok = tokenizers.ByteLevelBPETokenizer()
    tok.train(files=[p], vocab_size=500, min_frequency=2, special_tokens=BL.SPECIAL_TOKENS, show_progress=False)
    tok.save_model(tmpdir_path)
    ref = [tuple(x.split(" ")) for x in open(os.path.join(tmpdir_path, "merges.txt")).read().splitlines()
           if x and not x.startswith("#version")]
    ours = [(r.left, r.right) for r in model.merges.orderBy("rank").collect()]
    assert ours == ref
    vocab = json.load(open(os.path.join(tmpdir_path, "vocab.json")))
    assert {r.token: r.id for r in model.vocab.collect()} == vocab
    texts = LINES[:20] + ["Unseen wordz héllo 123 ☃"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs, model).collect()}
    assert got == {i: tok.encode(t).ids for i, t in enumerate(texts)}


def test_roundtrip_rate(spark, model):
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(LINES)], "ord long, text string")
    r = bpe.roundtrip(lines, model, 1000).first()
    assert r.roundtrip_checked == 400 and r.roundtrip_rate >= 0.95


def test_vocab_floor(spark):
    df = spark.createDataFrame([("tiny corpus line",), ("another line",)], "text string")
    m = bpe.train(bpe.word_counts(df), vocab_size=128)
    assert m.vocab_size == 260 and m.merges.count() == 0


def test_ensure_specials(spark):
    v = spark.createDataFrame([("a", 0), ("</s>", 1)], "token string, id int")
    out = {r.token: r.id for r in bpe.ensure_specials(v).collect()}
    assert out == {"a": 0, "</s>": 1, "<s>": 2, "<pad>": 3, "<unk>": 4}


def test_eos_by_name():
    assert BL.EOS_ID == BL.SPECIAL_TOKENS.index("</s>") == 2


def test_apply_merges_self_pair(spark):
    df = spark.createDataFrame([("a", 1, [1, 1, 1]), ("b", 1, [1, 1, 1, 1]), ("c", 1, [2, 1, 1]), ("d", 1, [])],
                               "word string, cnt long, ids array<int>")
    got = {r.word: list(r.ids) for r in bpe_train.apply_merges(df, [(1, 1, 9)]).collect()}
    assert got == {"a": [9, 1], "b": [9, 9], "c": [2, 9], "d": []}


def train_at_once(words, vocab_size, min_frequency=2):
    """The textbook loop: count all pairs, merge the best, again."""
    tokens = bpe_train.Tokens()
    state = [([BL.BASE_IDS[b] for b in w.encode()], n) for w, n in words]
    while len(tokens.tokens) < vocab_size:
        counts = {}
        for ids, n in state:
            for p in zip(ids, ids[1:]):
                counts[p] = counts.get(p, 0) + n
        best = min(((-n, *p) for p, n in counts.items() if n >= min_frequency), default=None)
        if best is None:
            break
        _, a, b = best
        new, _ = tokens.add(a, b)
        state = [(bpe_train.merge_ids(ids, {(a, b): (0, new)}), n) for ids, n in state]
    return tokens.merges


@pytest.mark.parametrize("top, size", [(2, 290), (40, 420), (1024, 420)])
def test_rounds_are_exact(spark, top, size):
    """Few letters, many ties, self pairs: the same merges whatever the number of pairs a round."""
    rnd = random.Random(top)
    words = {"".join(rnd.choice("aab") for _ in range(rnd.randint(1, 12))): rnd.randint(1, 4) for _ in range(60)}
    words |= {"".join(rnd.choice("abcdé ") for _ in range(rnd.randint(1, 9))): rnd.randint(1, 3) for _ in range(120)}
    df = spark.createDataFrame(list(words.items()), "word string, cnt long").repartition(3)
    want = train_at_once(list(words.items()), size)
    tokens, state, rounds = bpe_train.train_tables(df, size, 2, top_pairs=top)
    assert tokens.merges == want
    assert rounds < len(want)
    spelt = {r.word: "".join(tokens.tokens[i] for i in r.ids) for r in state.collect()}
    assert spelt == {w: "".join(BL.BYTE_CHARS[b] for b in w.encode()) for w in words}


def test_rounds_with_few_runs_allowed(spark):
    """A bound on the driver's runs changes the rounds, not the merges."""
    words = [(f"{a}{b}{c}", 1 + (a + b) % 3) for a in range(5) for b in range(5) for c in range(5)]
    df = spark.createDataFrame(words, "word string, cnt long")
    want = train_at_once(words, 275)
    assert bpe_train.train_tables(df, 275, 2, top_pairs=64, max_run_ids=8)[0].merges == want


def test_encode_shuffles_no_word(spark, model, capsys):
    docs = spark.createDataFrame([(1, "The quick brown fox"), (2, None), (3, "")], "doc_id long, text string")
    got = bpe.encode(docs, model)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert {r.doc_id: len(r.ids) > 0 for r in got.collect()} == {1: True, 2: False, 3: False}


def test_pieces_equal_whole_documents(spark, model, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_WORDS", 3)
    docs = spark.createDataFrame([("s", 1, LINES[0]), ("s", 2, ""), ("s", 3, "x"), ("s", 4, LINES[1] * 50)],
                                 "shard string, ord long, text string")
    whole = {r.ord: list(r.ids) for r in bpe.encode(docs, model, key="ord", eos=True).collect()}
    parts = {}
    for r in bpe.encode_pieces(docs, model).orderBy("ord", "piece").collect():
        parts.setdefault(r.ord, []).extend(r.ids)
    assert parts == whole


@pytest.mark.parametrize("size", [360, 32_000])
def test_matches_library_on_documents(spark, tmpdir_path, size):
    """Real multilingual text: deduplicated documents of the smallest test scale, 100 merges and all
    that a vocabulary of 32,000 takes."""
    tokenizers = pytest.importorskip("tokenizers")
    from tessera.operators import dedupe
    from tessera.sources import tables
    docs = tables.documents(spark, "/root/testdata/sf0.001", "doc_id", "text", "ord")
    kept = dedupe.first_per_digest(dedupe.clean(docs)).orderBy("ord").select("text").collect()
    p = os.path.join(tmpdir_path, "docs.txt")
    with open(p, "w", encoding="utf-8") as f:
        f.write("\n".join(r.text for r in kept) + "\n")
    tok = tokenizers.ByteLevelBPETokenizer()
    tok.train(files=[p], vocab_size=size, min_frequency=2, special_tokens=BL.SPECIAL_TOKENS, show_progress=False)
    tok.save_model(tmpdir_path)
    ref = [tuple(x.split(" ")) for x in open(os.path.join(tmpdir_path, "merges.txt"), encoding="utf-8").read().splitlines()
           if x and not x.startswith("#version")]
    m = bpe.train(bpe.word_counts(spark.createDataFrame([(r.text,) for r in kept], "text string")), vocab_size=size)
    assert [(r.left, r.right) for r in m.merges.orderBy("rank").collect()] == ref


def test_a_roundtrip_computes_its_lines_once(spark):
    model = bpe.train(bpe.word_counts(spark.createDataFrame([("the line and the lines",)], "text string")), 266, 1)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    lines = spark.createDataFrame([(k, f"line {k}") for k in range(40)], "ord long, text string").mapInArrow(count, "ord long, text string")
    r = bpe.roundtrip(lines, model, 1000).first()
    assert (r.roundtrip_checked, r.roundtrip_exact) == (40, 40)
    assert seen.value == 40


def test_words_are_encoded_a_few_rows_at_a_time(spark, monkeypatch):
    import pyarrow as pa
    model = bpe.train(bpe.word_counts(spark.createDataFrame([("the line and the lines",)], "text string")), 266, 1)
    table, sizes, one = bpe.rank_table(model).value, [], bpe._encode_batch
    lists = pa.array([["ab", " the"] * (k % 5) if k % 7 else None for k in range(1000)], pa.list_(pa.string()))
    whole = one(lists, table).to_pylist()
    monkeypatch.setattr(bpe, "_encode_batch", lambda some, t: sizes.append(len(some)) or one(some, t))
    assert bpe.encode_lists(lists, table).to_pylist() == whole
    assert max(sizes) <= bpe.ROWS_AT_ONCE < 1000
    assert bpe.encode_lists(lists[:0], table).to_pylist() == []


def test_pieces_and_their_eos_come_from_one_pass(spark, monkeypatch):
    model = bpe.train(bpe.word_counts(spark.createDataFrame([("the line and the lines",)], "text string")), 266, 1)
    monkeypatch.setattr(bpe, "PIECE_WORDS", 2)
    texts = ["the line and", "", "the", "a b c d"]
    docs = spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], "shard string, ord long, text string")
    rows = bpe.encode_pieces(docs, model).orderBy("ord", "piece").collect()
    whole = {r.doc_id: r.ids for r in bpe.encode(docs.withColumnRenamed("ord", "doc_id"), model, eos=True).collect()}
    for k in range(len(texts)):
        assert [i for r in rows if r.ord == k for i in r.ids] == whole[k]
    assert "Union" not in bpe.encode_pieces(docs, model)._jdf.queryExecution().optimizedPlan().toString()
