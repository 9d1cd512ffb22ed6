"""Each operator against a brute-force version, on the smallest documents table and on a fixture
with nulls, empty and long texts, ties, repeated rows and extra columns with clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import (components, line_dedup, merkle, minhash, mixing, quality, queries, sentencepiece_bpe, sharding,
                         suffix_dedup, suffix_groups, toxicity, url_filter)
from tessera.llm.common import read

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("_id", T.StringType()),
                     T.StructField("n_lines", T.StringType()), T.StructField("kept", T.StringType()),
                     T.StructField("_key", T.StringType())])


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def fixture_rows():
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(80)]

    def line(n):
        return " ".join(rnd.choice(words) for _ in range(n))
    common, passage = "A line that MANY documents hold", line(60)
    out = [(1, None, "a"), (2, "", None), (3, " \n\n ", "b"), (4, common + "\n" + line(30), "a"),
           (5, "  " + common.lower() + "\t\n" + line(30) + "\n" + common, None), (6, passage, "c")]
    base = [rnd.choice(words) for _ in range(120)]
    for k in range(12):  # near copies
        w = list(base)
        for _ in range(k // 3):
            w[rnd.randrange(120)] = rnd.choice(words)
        out.append((10 + k, " ".join(w), "a" if k % 2 else "hot"))
    for k in range(20):
        out.append((30 + k, "\n".join(line(rnd.randint(1, 25)) for _ in range(rnd.randint(1, 8))), "hot"))
    out += [(60, passage + "\n" + line(20), "b"), (61, line(10) + passage[5:], "b"), (62, "x" * 3000, "c"),
            (63, "ab" * 700 + " ü漢🙂 " + line(3), "c"), (64, line(9000), "hot"), (65, out[8][1], "hot"),
            (65, out[8][1], "hot"), (None, line(40), None), (None, out[9][1], "a"), (70, "idiot $$$ | ### tie", "a")]
    return [(*r, "x", "y", "z", "k") for r in out]


ROWS = fixture_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(spark):
    return [(r["doc_id"], r["text"], r["source"]) for r in read(spark, SF, "documents").collect()]


def brute_lines(rows):
    keys, owners = [], defaultdict(set)
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        k = [line_dedup.line_key(x) for x in lines]
        keys.append((doc_id, lines, k))
        for x in k:
            if len(x) >= 10:
                owners[x].add((doc_id is None, doc_id))
    out = []
    for doc_id, lines, k in keys:
        kept = [x for x, y in zip(lines, k) if len(owners.get(y, ())) < 2 or
                min(owners[y], key=lambda o: (o[0], o[1] or 0)) == (doc_id is None, doc_id)]
        out.append((doc_id, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def test_line_dedup(spark, docs, none):
    out = line_dedup.line_dedup(docs)
    assert set(out.columns) == set(docs.columns) | {"n_dropped"}
    got = [(r["doc_id"], r["n_lines"], r["n_dropped"], sha(r["text"])) for r in out.collect()]
    assert Counter(got) == Counter(brute_lines(ROWS))
    query = [(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in queries.op1_line_dedup(spark, SF).collect()]
    assert Counter(query) == Counter(brute_lines(texts_of(spark)))
    assert sum(r[2] for r in query) > 0
    three = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(docs, min_docs=3).collect()}
    assert three[5] == 0
    assert line_dedup.line_dedup(none).count() == 0


def test_sentencepiece(spark, docs, none):
    import sentencepiece

    path = queries.piece_model()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    for rows, frame in ((ROWS, sentencepiece_bpe.digest(docs, path)), (texts_of(spark), queries.op2_sentencepiece(spark, SF))):
        want = Counter()
        for doc_id, text, *_ in rows:
            ids = lib.encode(text or "")
            want[doc_id, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))] += 1
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in frame.collect()) == want
    again = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs, path), path)
    assert all(r["decoded"] == (r["text"] or "") for r in again.select("text", "decoded").collect())
    assert sentencepiece_bpe.digest(none, path).count() == 0


def test_sentencepiece_strings():
    import sentencepiece

    model = open(queries.piece_model(), "rb").read()
    lib, own, rnd = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_bpe.vocabulary(model), random.Random(1)
    chars = " \n\t▁aabcdeésß漢🙂.,-_<>09tthe"
    for k in range(6000):
        if k % 2:
            text = "".join(rnd.choice(chars) for _ in range(rnd.randint(0, 14)))
        else:
            text = "".join(rnd.choice(own.pieces[260:]) for _ in range(rnd.randint(0, 6))).replace("▁", " ")
        ids = lib.encode(text)
        assert own.encode(text) == ids, text
        assert own.decode(ids) == lib.decode(ids), text
        assert own.round_trip(text) == (len(ids), ",".join(map(str, ids)), lib.decode(ids))
        some = [rnd.randrange(3, 259) if rnd.random() < 0.5 else rnd.randrange(32000) for _ in range(rnd.randint(0, 6))]
        assert own.decode(some) == lib.decode(some)


def test_sentencepiece_long_runs():
    import sentencepiece

    model = open(queries.piece_model(), "rb").read()
    lib, rnd = sentencepiece.SentencePieceProcessor(model_proto=model), random.Random(2)
    own = sentencepiece_bpe.Vocabulary(model)
    for chars in ("0123456789", "\t", "漢字中文語言", "🙂🎉🚀", "กขคงจ", "かなカナ", "7", "0a漢🙂\tthe"):
        run = "".join(rnd.choice(chars) for _ in range(5000))
        for text in (run, f"some words {run} and more\n{run}"):
            ids = lib.encode(text)
            assert own.round_trip(text) == (len(ids), ",".join(map(str, ids)), lib.decode(ids))


def brute_edits(rows):
    rows = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    out = Counter()
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        a, b, c = map(merkle.fingerprint, (text, edited, after))
        out[doc_id, len(text), sha(edited), a, b, merkle.likeness(a, b), merkle.likeness(a, c)] += 1
    return out


def test_fingerprints(spark, docs, none):
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for rows, frame in ((ROWS, merkle.edit_report(docs)), (texts_of(spark), queries.op3_fingerprints(spark, SF))):
        assert Counter(tuple(r) for r in frame.select(columns).collect()) == brute_edits(rows)
    assert merkle.edit_report(none).count() == 0
    one = docs.where("doc_id = 64")
    assert merkle.edit_report(one).first()["near_next"] == 1.0
    of = {r["doc_id"]: r["fingerprint"] for r in merkle.fingerprints(docs).collect()}
    assert of[65] == merkle.fingerprint(ROWS[8][1]) == of[ROWS[8][0]]


def test_fingerprints_of_text_ids(spark):
    rows = [(None if k % 9 == 0 else f"urn:é{k % 30}", f"text {k}. " * (k % 5)) for k in range(60)]
    got = merkle.edit_report(spark.createDataFrame(rows, "doc_id string, text string").repartition(4))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"],
                    r["near_next"]) for r in got.collect()) == brute_edits(rows)


def test_clashing_columns(spark):
    """Columns that have the names of an operator's own come back as they were."""
    rows = [(1, "a line of text\n" + "x" * 300, *"pqrstuv"), (2, "A line of text \nother\n" + "x" * 300, *"pqrstuv"), (None, None, *"pqrstuv")]
    names = ["_gone", "_gone_doc", "_r", "_d", "_ranges", "_text_key", "_cut_key"]
    frame = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    lines = line_dedup.line_dedup(frame)
    assert {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in lines.collect()} == {(1, 2, 0), (2, 3, 2), (None, 1, 0)}
    tokens = sentencepiece_bpe.digest(frame, queries.piece_model())
    spans = suffix_dedup.remove_repeats(frame)
    assert {(r["doc_id"], r["n_spans"]) for r in spans.collect()} == {(1, 1), (2, 1), (None, 0)}
    for out in (lines, tokens, spans):
        assert all([r[n] for n in names] == list("pqrstuv") for r in out.collect())


def test_merkle_locates_edits():
    a = "\n".join(f"line {k}, with some words. And more" for k in range(40))
    b = a.replace("line 19,", "row 19,")
    x, y = merkle.fingerprint(a), merkle.fingerprint(b)
    assert merkle.differing(x, y) == [(2, 3)] and merkle.differing(x, x) == []
    assert 0.9 < merkle.likeness(x, y) < 1 and merkle.likeness(x, x) == 1.0
    assert merkle.likeness(x, merkle.fingerprint("other text")) == 0.0
    for s in (a, "", "\n\n", "x\n\ny\n"):
        assert "\n".join(line for sec in merkle.sections(s) for line in sec) == s


def targets_of(rows):
    sizes = Counter()
    for _, text, source, *_ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    full, target, left = set(), {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        rest = left - sum(2 * sizes[s] for s in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return sizes, target
        full |= over


def check_mix(rows, got):
    sizes, target = targets_of(rows)
    by_source, largest = Counter(), Counter()
    for _, text, source, *_ in rows:
        largest[source] = max(largest[source], len(WORD.findall(text or "")))
    assert len(got) == len(rows)
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    sources = {}
    for s in sizes:
        sources.setdefault((sizes[s], round(target[s], 6)), []).append(s)
    taken = Counter()
    for r in got:
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    for key, names in sources.items():
        assert abs(taken[key] - key[1] * len(names)) <= sum(largest[s] for s in names) + 1e-6, key


def test_mixing(spark, docs, none):
    out = mixing.mix(docs).collect()
    check_mix(ROWS, out)
    assert Counter(map(tuple, out)) == Counter(map(tuple, mixing.mix(docs.repartition(5), fan=32).collect()))
    check_mix(texts_of(spark), queries.op4_mixing(spark, SF).collect())
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 37).cast("int")).alias("text"),
                                    F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("s"), F.col("id") % 11)).alias("source"))
    mixed = mixing.mix(many, fan=8)
    check_mix([tuple(r) for r in many.collect()], mixed.collect())
    taken = mixing.apply_mix(many, mixed)
    assert taken.columns == many.columns
    assert taken.count() == mixed.agg(F.sum("copies")).first()[0]
    # every document is taken as often as its source's share says, on average
    free = mixed.where("source_size > 5000 and size > 0").selectExpr("avg(copies - target / source_size) d").first()["d"]
    assert abs(free) < 0.05
    assert mixing.mix(none).count() == 0
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_apply_mix_takes_the_words_decided(spark):
    """Null and repeated ids, alike sizes, extra columns with the names that a join may use."""
    rows = [(None if k % 2 else 7 if k % 5 == 0 else k, "w " * (1 + k % 23), "ab"[k % 3 == 0], k, k, k, k) for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _copy int, _copies int, _mix_id int, mix_number int")
    mixed = mixing.mix(docs)
    out = mixing.apply_mix(docs, mixed)
    assert out.columns == docs.columns
    assert out.select(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] == mixed.agg(F.sum("taken")).first()[0]
    by_size = Counter((r["doc_id"], len(r["text"].split())) for r in out.collect())
    want = Counter()
    for r in mixed.collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    assert by_size == Counter({k: n for k, n in want.items() if n})
    kept = {r["_copy"]: r for r in out.collect()}
    assert all((r["_copies"], r["_mix_id"], r["mix_number"]) == (k, k, k) for k, r in kept.items())


def test_mixing_deals_rows_of_one_id(spark, monkeypatch):
    # a third null ids, a third one id, a third of these two alike in size too
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, "w " * (1 if k % 9 < 3 else 1 + k % 23), "ab"[k % 5 == 0])
            for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    folded, store = {}, mixing.materialize

    def seen(frame, name):
        out = store(frame, name)
        if name.startswith("mix-level"):
            folded[name] = out.agg(F.max(F.size("done"))).first()[0]
        return out
    monkeypatch.setattr(mixing, "materialize", seen)
    got = mixing.mix(docs).collect()
    check_mix(rows, got)
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert folded and max(folded.values()) < 4 * mixing.FAN
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(5)).collect()))


def brute_quality(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = set()
    for k in range(len(words) - 4):
        if windows[tuple(words[k:k + 5])] > 1:
            covered.update(range(k, k + 5))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed)


def test_quality_counts(spark, docs, none):
    labels = read(spark, SF, "labels")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    out = quality.judge(docs, labels)
    assert set(docs.columns) <= set(out.columns)
    got = Counter((r["doc_id"], *[r[c] for c in columns]) for r in out.collect())
    assert got == Counter((r[0], *brute_quality(r[1])) for r in ROWS)
    assert not out.where("base_failed and kept").count()
    assert quality.judge(none, labels).count() == 0
    base_only = quality.judge(docs, labels.limit(0))
    assert base_only.where("kept = base_failed").count() == 0
    rnd = random.Random(5)
    for _ in range(300):
        words = [rnd.choice("ab") for _ in range(rnd.randint(0, 40))]
        assert quality.repeated_words(words) == brute_quality(" ".join(words))[4]


def test_crf_paths():
    import itertools

    import numpy as np

    rnd = np.random.default_rng(2)
    for n in range(1, 8):
        emit, move = rnd.normal(size=(n, 2)), rnd.normal(size=(2, 2))

        def score(path):
            return sum(emit[k, y] for k, y in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:]))
        paths = list(itertools.product((0, 1), repeat=n))
        assert tuple(quality.viterbi(emit, move)) == max(paths, key=score)
        # the same sequence, once whole and once with lines that it doesn't have
        odds = np.exp([score(p) for p in paths])
        odds /= odds.sum()
        want = np.array([[sum(o for o, p in zip(odds, paths) if p[k] == y) for y in (0, 1)] for k in range(n)])
        moves = [[sum(o * sum(p[k:k + 2] == (a, b) for k in range(n - 1)) for o, p in zip(odds, paths)) for b in (0, 1)] for a in (0, 1)]
        twice = np.concatenate([np.stack([emit, emit], 1), rnd.normal(size=(3, 2, 2))])
        on = np.ones((n + 3, 2), bool)
        on[n:] = False
        each, both = quality.expectations(twice, move, on)
        assert np.allclose(each[:n, 0], want) and np.allclose(each[:n, 1], want) and not each[n:].any()
        assert np.allclose(both, 2 * np.array(moves))


def test_quality_verdicts(spark):
    """Documents labelled good stay, most labelled bad ones go."""
    sf = "/root/testdata/sf0.01"
    out = queries.op5_quality(spark, sf).join(read(spark, sf, "labels"), "doc_id").where("not base_failed")
    kept = {r["quality"]: r["k"] for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[1] > 0.97 and kept[0] < 0.3


def test_quality_spliced(spark):
    """A good text with a block of another's junk lines: the share of content follows the block."""
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "labels")
    rows = sorted(docs.join(labels, "doc_id").collect())
    good = [r for r in rows if r["quality"] == 1 and 5 < r["text"].count("\n") < 60][:25]
    bad = [r for r in rows if r["quality"] == 0][:25]
    mixed = [(k, g["text"] + "\n" + b["text"], len(WORD.findall(g["text"])) / len(WORD.findall(g["text"] + "\n" + b["text"])))
             for k, (g, b) in enumerate(zip(good, bad))]
    known = docs.where(~F.col("doc_id").isin([r["doc_id"] for r in good + bad]))  # the fit sees none of them
    model = quality.fit(known, labels)
    shares = [quality.judge_text(text, model)[-1] for _, text, _ in mixed]
    assert sum(0 < s < 1 for s in shares) > 0.6 * len(mixed)
    assert sum(abs(s - w) < 0.15 for s, (_, _, w) in zip(shares, mixed)) > 0.6 * len(mixed)


def test_toxicity(spark, docs, none):
    sf = "/root/testdata/sf0.1"
    out = queries.op6_toxicity(spark, sf)
    rows = out.join(read(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 300
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.97
    labels = read(spark, sf, "labels")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        doc_id = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(doc_id.encode()) % 5 == 0)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert all(r["score"] == 0 for r in toxicity.score_toxicity(docs, labels.limit(0)).collect())


def test_toxicity_restores(spark):
    logp = toxicity.character_model(read(spark, "/root/testdata/sf0.01", "documents"))
    for seen, want in (("1d10t", "idiot"), ("m0r0n", "moron"), ("tr4sh", "trash"), ("$tupid", "stupid"), ("idiooooot", "idiot")):
        assert toxicity.restore(seen, logp) == want
    assert toxicity.restore("the i d i o t said", logp) == "the idiot said"
    assert toxicity.restore("plain words, and 12 more.", logp) == "plain words, and 12 more."


def test_toxicity_reads_all_disguises(spark):
    docs = read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    logp = toxicity.character_model(docs)
    for want, forms in (("idiot", "idi07 1d107 iidiott i/d/i/o/t i,d,i,o,t"), ("moron", "moroon m0ron m-o-r-o-n"),
                        ("stupid", "stuupid 5tup1d s.t.u.p.i.d"), ("shit", "5h17"), ("kill", "ki11 kil1")):
        for seen in forms.split():
            assert toxicity.restore(seen, logp) == want, seen
    for seen, want in (("the st u p id one", "the stupid one"), ("you d i e now", "you die now"),
                       ("they said l  o  s  e  r", "they said loser"), ("the t r a s h of it", "the trash of it"),
                       ("s c u", "scu"), ("a thing of, and the end.", "a thing of, and the end."),
                       ("on 10.12.2019, or 12", "on 10.12.2019, or 12")):
        assert toxicity.restore(seen, logp) == want
    # documents disguised only in these ways are found, those of the same plain words are not
    forms = ["idi07 and moroon stuupid", "i/d/i/o/t and l  o  s  e  r", "the st u p id one, m, o, r, o, n", "1d107 5tup1d iidiott"]
    texts = [f"the thing is {f} in the end of {f}" for f in forms] + ["the thing is 12 and all the good in the end of 7"]
    ids = [k for k in range(10 ** 6, 10 ** 6 + 100) if zlib.crc32(str(k).encode()) % 5 == 0]
    extra = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = toxicity.score_toxicity(docs.unionByName(extra), read(spark, "/root/testdata/sf0.01", "labels"))
    marked = {r["doc_id"]: r["predicted"] for r in got.where("doc_id >= 1000000").collect()}
    assert [marked[k] for k in ids[:len(texts)]] == [1] * len(forms) + [0]


def brute_near(rows, width, percent=80):
    def shingle(text):
        table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        w = WORD.findall((text or "").translate(table))
        return {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    sets = [shingle(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return Counter((r[0], len(s), None if r[0] is None else least[root(i)], r[0] is None or least[root(i)] == r[0])
                   for i, (r, s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("width", [4, 5])
def test_near_dedup(spark, docs, none, width):
    assert Counter(map(tuple, minhash.near_dedup(docs, width=width).collect())) == brute_near(ROWS, width)
    frame = minhash.near_dedup(read(spark, SF, "documents"), width=width)
    assert Counter(map(tuple, frame.collect())) == brute_near(texts_of(spark), width)
    assert minhash.near_dedup(none).count() == 0


def test_near_dedup_chains(spark):
    """Chains of texts, each near the one before but far from the first: the star alone is not enough."""
    rnd = random.Random(9)
    rows = []
    for c in range(6):
        w = [f"w{rnd.randrange(10**6)}" for _ in range(200)]
        for k in range(14):
            rows.append((rnd.randrange(10**9), " ".join(w)))
            for _ in range(5):
                w[rnd.randrange(200)] = f"w{rnd.randrange(10**6)}"
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, minhash.near_dedup(frame).collect())) == brute_near(rows, 4)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "_u long, _v long")).collect()))
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def brute_repeats(rows, window=200):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(d[k:k + window] for d in data for k in range(len(d) - window + 1))
    out = Counter()
    for r, d in zip(rows, data):
        gone = bytearray(len(d))
        for k in range(len(d) - window + 1):
            if seen[d[k:k + window]] > 1:
                gone[k:k + window] = b"\1" * window
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out[r[0], len(d), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)] += 1
    return out


def test_suffix_dedup(spark, docs, none):
    for limit in (4096, 1):  # the second sends every open anchor through counted windows
        out = suffix_dedup.remove_repeats(docs, max_kinds=limit)
        assert set(out.columns) == set(docs.columns) | {"n_bytes", "n_removed", "n_spans"}
        got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"]))) for r in out.collect())
        assert got == brute_repeats(ROWS)
    got = Counter(tuple(r) for r in queries.op8_suffix_dedup(spark, SF).collect())
    assert got == brute_repeats(texts_of(spark))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_bytes(spark):
    """Small alphabets, overlaps and repeats inside one text."""
    rnd = random.Random(6)
    rows = []
    for k in range(30):
        part = "".join(rnd.choice("ab") for _ in range(260))
        rows.append((k, "".join(rnd.choice([part[:rnd.randint(100, 260)], part, "é", "q" * rnd.randint(1, 230)]) for _ in range(rnd.randint(1, 4)))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], sha(bytes(r["kept"])))
                  for r in suffix_dedup.remove_repeats(frame).collect())
    assert got == brute_repeats(rows)


def test_suffix_array():
    rnd = random.Random(0)
    for _ in range(4000):
        x = [rnd.randint(1, rnd.choice([1, 2, 3, 8])) for _ in range(rnd.randint(0, 16))] + [0]
        assert suffix_groups.suffix_array(x) == sorted(range(len(x)), key=lambda k: x[k:])


def check_shards(rows, got, shards=16):
    assert len(got) == len(rows)
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    load, slots, place = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        place[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    assert all(len(s) == 1 for s in place.values())
    groups = Counter()
    for r in rows:
        groups[r[1] or ""] += len((r[1] or "").encode()) + 1
    largest = max(groups.values())
    assert max(load.values()) - min(load[k] for k in range(shards)) <= largest


def test_sharding(spark, docs, none):
    check_shards(ROWS, sharding.shard(docs).collect())
    check_shards(ROWS, sharding.shard(docs, slot_rows=1).collect())
    check_shards(ROWS, sharding.shard(docs, block_groups=4).collect())
    out = queries.op9_sharding(spark, SF)
    check_shards(texts_of(spark), out.collect())
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, queries.op9_sharding(spark, SF).collect()))
    assert sharding.shard(none).count() == 0
    few = [(size, str(k)) for k, size in enumerate([7, 5, 5, 4, 3, 2])]
    assert sharding.schedule(few, 2) == {"0": 0, "1": 1, "2": 1, "3": 0, "4": 1, "5": 0}


def test_sharding_is_lpt(spark):
    """One block: the plain schedule of all groups. Many blocks: shards as near as the smallest groups allow."""
    rnd = random.Random(8)
    rows = [(k, "w" * int(rnd.paretovariate(1.2)) + str(k % 700)) for k in range(3000)] + [(None, "same")] * 40
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sizes = Counter()
    for _, text in rows:
        sizes[text] += len(text) + 1
    for blocks in (1 << 16, 100):
        got = sharding.shard(frame, block_groups=blocks, slot_rows=5).collect()
        check_shards(rows, got)
        load = Counter()
        for r in got:
            load[r["shard"]] += r["size"]
        if blocks > len(sizes):
            plain = sharding.schedule([(n, t) for t, n in sizes.items()], 16)
            want = Counter()
            for t, n in sizes.items():
                want[plain[t]] += n
            assert sorted(load.values()) == sorted(want.values())
        elif max(sizes.values()) < sum(sizes.values()) / 16:
            assert max(load.values()) - min(load.values()) <= 16


def brute_url(url):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    fits = [(h + p, v) for h, p, v in url_filter.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))


def test_url_filter(spark):
    schema = "page_id long, url string, html string, _id string, host string"
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x?q", "http://example.net", "http://b.net/EN/", "ftp://x.org/fr/1#f",
            "http://org/fr/", "http://notnet/", "http://a.net:80/", "http://de.example.com/de/9", "http://example.com/de", "http://x.org/fr",
            "http://ünï.net/", "http://" + "a" * 400 + ".example.com/", "http://ü?://x.net/"] * 2
    frame = spark.createDataFrame([(k % 20 or None, u, None if k % 3 else "<p>example words</p>", "x", "y") for k, u in enumerate(urls)], schema)
    pages = read(spark, SF, "pages")
    want = [(k % 20 or None, u) for k, u in enumerate(urls)]
    for rows, out in ((want, url_filter.judge_urls(frame).collect()),
                      ([(r["page_id"], r["url"]) for r in pages.collect()], queries.op10_url_filter(spark, SF).collect())):
        assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in out) == Counter((i, *brute_url(u)[:3]) for i, u in rows)
        by_rule = {f"{h}{p}": v for h, p, v in url_filter.RULES}
        assert all(r["verdict"] == by_rule[r["rule"]] if r["rule"] else r["verdict"] in ("allow", "block") for r in out)
    assert url_filter.judge_urls(frame.limit(0)).count() == 0


def plain_segment(label, logp, total):
    """Every cut at every end."""
    import math

    best = [(0.0, [])]
    for end in range(1, len(label) + 1):
        best.append(max(((best[start][0] + logp.get(label[start:end], -math.log(total) - (end - start) * math.log(10.0)),
                          best[start][1] + [label[start:end]]) for start in range(end)), key=lambda x: x[0]))
    return best[-1]


def test_url_segmentation():
    import math
    import time

    logp = {w: math.log(n / 100) for w, n in (("the", 30), ("ring", 10), ("thering", 1), ("in", 20), ("g", 5))}
    assert url_filter.segment("thering", logp, 100.0) == ["the", "ring"]
    assert url_filter.segment("", logp, 100.0) == []
    assert url_filter.segment("zzq", logp, 100.0) == ["zzq"]
    assert url_filter.segment("z" * 50, logp, 100.0) == ["z" * 50]
    rnd = random.Random(4)
    for _ in range(300):
        words = {"".join(rnd.choice("abc") for _ in range(rnd.choice([1, 2, 3, 5, 25]))): rnd.randint(1, 9) for _ in range(8)}
        total = float(sum(words.values()) + 3)
        logp = {w: math.log(n / total) for w, n in words.items()}
        label = "".join(rnd.choice([*words, "a", "b", "d"]) for _ in range(rnd.randint(0, 8)))
        got = url_filter.segment(label, logp, total)
        cost = sum(logp.get(w, -math.log(total) - len(w) * math.log(10.0)) for w in got)
        assert "".join(got) == label and abs(cost - plain_segment(label, logp, total)[0]) < 1e-9
    start = time.time()
    assert "".join(url_filter.segment("abcd" * 25_000, logp, 100.0)) == "abcd" * 25_000
    assert time.time() - start < 20


def plain_scores(rows):
    """Scores by host and path with dictionaries: rows are (url, html)."""
    import math

    import regex

    words = Counter(w for _, html in rows for w in regex.split(r"[^\p{L}]+", re.sub("<[^>]*>", " ", (html or "").lower())) if w)
    total = float(sum(words.values()) or 1)
    logp = {w: math.log(n / total) for w, n in words.items()}

    def tokens(host, path):
        out = [("h:" + w) for label in regex.split(r"[^\p{L}]+", host) if label for w in plain_segment(label, logp, total)[1]]
        plain = re.sub("[0-9]+", " 0 ", re.sub("[0-9]+", "0", path).lower())
        return out + ["p:" + w for w in regex.split(r"[^\p{L}0]+", plain) if w]
    memo = {}
    parts = [brute_url(u)[:3] for u, _ in rows]
    verdicts = {f"{h}{p}": v for h, p, v in url_filter.RULES}
    block, allow, seen = Counter(), Counter(), Counter()
    for host, path, rule in parts:
        t = memo.setdefault((host, path), tokens(host, path))
        if rule:
            seen[verdicts[rule]] += 1
            (block if verdicts[rule] == "block" else allow).update(t)
    vocabulary = set(block) | set(allow)
    size = len(vocabulary) or 1
    n_block, n_allow = sum(block.values()), sum(allow.values())

    def score(host, path):
        out = math.log((seen["block"] + 1) / (seen["allow"] + 1))
        return out + sum(math.log((block[t] + 1) / (n_block + size)) - math.log((allow[t] + 1) / (n_allow + size))
                         for t in memo[host, path] if t in vocabulary)
    return {(host, path): score(host, path) for host, path, _ in parts}


def test_url_scores(spark):
    """Weights and scores against a plain version."""
    import math

    pages = read(spark, SF, "pages")
    out = url_filter.judge_urls(pages)
    rows = out.collect()
    want = plain_scores([(r["url"], r["html"]) for r in pages.collect()])
    assert all(abs(r["score"] - want[r["host"], r["path"]]) < 1e-6 for r in rows)
    long = "word" * 8
    odd = [(1, f"http://x{long}y.{'ab' * 20_000}.org/de/", f"<p>{long} ab</p>"), (2, "http://a.net/x", long), (3, "http://x.org/fr/b", "x y")]
    got = url_filter.judge_urls(spark.createDataFrame(odd, "page_id long, url string, html string")).collect()
    assert len(got) == 3 and {r["page_id"]: r["verdict"] for r in got}[2] == "block"
    judged = [r for r in rows if r["rule"]]
    assert judged and len(rows) > len(judged)
    blocked = sum(r["verdict"] == "block" for r in judged)
    assert math.isfinite(sum(r["score"] for r in rows))
    agree = sum((r["score"] > 0) == (r["verdict"] == "block") for r in judged) / len(judged)
    assert agree > 0.8 and 0 < blocked < len(judged)
    assert all((r["verdict"] == "block") == (r["score"] > 0) for r in rows if not r["rule"])
