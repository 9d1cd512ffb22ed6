"""Word BPE against the library; the filter audit and conversation repair against brute force, with
nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import functools
import hashlib
import random
import re
import unicodedata
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation_repair, queries, survival, word_bpe

SF = "/root/testdata/sf0.001"
WHITE = set("\t\n\x0b\x0c\r ")


# ---- 11 ----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_vocabulary())


@pytest.fixture(scope="module")
def words():
    return word_bpe.vocabulary(word_bpe._spec(queries.word_vocabulary()))


def same_as_library(words, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert words.encode(text) == ids, ascii(text[:200])
    plain = library.decode(ids, skip_special_tokens=False)
    assert words.decode(ids) == plain
    assert words.round_trip(text) == (len(ids), " ".join(map(str, ids)), plain)


def test_word_bpe_random_strings(words, library):
    rnd = random.Random(11)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    apart = [d for c in every if (d := unicodedata.normalize("NFD", c)) != c]
    for _ in range(3000):
        same_as_library(words, library, "".join(rnd.choice([
            rnd.choice(every), rnd.choice(every[:0x3000]), rnd.choice(apart), rnd.choice(" \n\t'sSdDlLtTΣςİabc.!1\x00\x1c\x85"),
            "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "'re", "'LL"]) for _ in range(rnd.randint(0, 30))))


def test_word_bpe_every_mark_and_class(words, library):
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.combining(ch):
            same_as_library(words, library, "a\u0301" + ch + "\u0327 e" + ch)
    for ranges in (word_bpe.LETTERS, word_bpe.NUMBERS, [r[:2] for r in word_bpe.LOWER]):
        for a, b in ranges:
            for c in (a, b):
                same_as_library(words, library, "x" + chr(c) + "1-" + chr(c))


def test_word_bpe_long_words(words, library):
    rnd = random.Random(3)
    for n in (1, 255, 256, 257, 1000, 20000):
        for w in ("a" * n, "é" * n, "!" * n, "".join(rnd.choice("etaoinshr") for _ in range(n))):
            same_as_library(words, library, w)


def test_word_bpe_digest(spark, library):
    rows = [(1, None, "x", "y"), (2, "", "x", "y"), (2, "", "x", "y"), (None, "Hello  World<|endoftext|>", "x", "y"),
            (3, "ab\u0301c " * 30000, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n_tokens string")
    path = queries.word_vocabulary()
    got = word_bpe.digest(docs, path).collect()
    assert len(got) == 5 and {r["digest"] for r in got} == {"x"}
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        plain = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest())
    assert word_bpe.digest(docs.where("false"), path).count() == 0
    both = word_bpe.decode(word_bpe.encode(docs, path), path).collect()
    assert {r["decoded"] for r in both if r["doc_id"] is None} == {"hello</w> world</w> <|endoftext|>"}


def test_word_bpe_query(spark, library):
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_word_bpe"](spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_word_bpe_refuses_other_files():
    import public_tokenizers

    with pytest.raises((ValueError, KeyError, TypeError, AttributeError)):
        word_bpe.Vocabulary(word_bpe._spec(public_tokenizers.path("byte_bpe_50k.json")))


# ---- 12 ----------------------------------------------------------------------------------

def test_carry_save_addition():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 5, 64, 1000):
        words = rnd.integers(0, 1 << 32, n).astype(np.uint64)
        planes = survival.add_up([words])
        assert all(len(p) <= 1 for p in planes)
        assert survival.read_off(planes, 32) == [int((words >> np.uint64(s) & np.uint64(1)).sum()) for s in range(32)]
        again = survival.add_up([np.concatenate([planes[0], words]), *planes[1:]])
        assert survival.read_off(again, 32) == [2 * int((words >> np.uint64(s) & np.uint64(1)).sum()) for s in range(32)]


def brute_audit(rows, labels):
    """rows: (doc_id, text, lang); labels: (doc_id, quality, toxic)."""
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, x in labels if x == 1}
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 "D": bool(re.search("[#$%&*|]", t)), "E": t in first and first[t] != i}
        docs.append((lang or "", {f for f, x in fails.items() if x}, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own),
                    sum(d[2] for d in gone), sum(d[3] for d in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def audit_rows():
    rnd = random.Random(12)
    vocabulary = [f"w{k}" for k in range(400)] + ["UPPER", "Mixed", "a#b", "c&d"]
    texts = [None, "", " \n", "SHOUT " * 120, "x" * 5000] + [
        " ".join(rnd.choice(vocabulary if k % 3 else vocabulary[:60 + k * 5]) for _ in range(rnd.choice([5, 99, 100, 101, 150, 300])))
        for k in range(40)]
    rows = [(i, rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for i in range(150)]
    rows += [(7, rows[7][1], "en"), (7, rows[7][1], "de"), (None, rows[9][1], "fr"), (None, "lone text", None), (None, "lone text", "fr")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 150, 2)]
    return rows, [*labels, (4, 1, 1), (4, 0, 0), (None, 1, 1), (9999, 1, 1)]


def test_audit_brute_force(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame([(*r, "x", 1, "m") for r in rows], "doc_id long, text string, lang string, part string, good int, mask string").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r[0], r[1], r[2]): tuple(r[3:]) for r in survival.audit(docs, marks).collect()}
    assert got == brute_audit(rows, labels)
    assert survival.audit(docs.where("false"), marks).count() == 0
    none = survival.audit(docs, marks.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (0, 0)


def test_audit_flushes(spark, monkeypatch):
    """Many parts and few words at a time: the same counts."""
    words = spark.range(0, 3000).select((F.col("id") % 700).cast("string").alias("part"), (F.col("id") * 7919 % (1 << 32)).alias("word"),
                                        (F.col("id") % 2 == 0).alias("good"), (F.col("id") % 3 == 0).alias("toxic"))
    want = {tuple(r) for r in survival.subset_survivors(words).collect()}
    monkeypatch.setattr(survival, "WAITING", 50)
    monkeypatch.setattr(survival, "GROUPS", 20)
    assert {tuple(r) for r in survival.subset_survivors(words).collect()} == want
    n = words.where("word & 8 <> 0").count()
    assert sum(r[3 + 3] for r in want) == n


# ---- 13 ----------------------------------------------------------------------------------

def damaged(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 1:
            x = ""
        if k == 2:
            x = re.sub("[.!?]", "", x)
        if k == 4:
            r = "user"
        out += [(c, t, r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        body = [ch for ch in x if ch not in WHITE]
        out.append("B" if not body else "D" if (r, x) in seen else "T" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(rows, found):
    """Least (cost, letters) of all edits, with up to two rows put in at a place, and the repaired rows."""
    legal = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}

    @functools.lru_cache(None)
    def rest(i, tail, put):
        ways = [(0, "", ())] if i == len(rows) and tail in ("", "a") else []

        def add(cost, letter, kept, after):
            if after:
                ways.append((cost + after[0], letter + after[1], kept + after[2]))
        roles = [r for r in ("user", "assistant") if (tail, r[0]) in legal]
        if put < 2:
            for r in roles:
                add(5, "I", ((r, ""),), rest(i, r[0], put + 1))
        if i < len(rows):
            role, text = rows[i][2:]
            add(2, "D", (), rest(i + 1, tail, 0))
            if found[i] not in ("B", "D"):
                extra = 5 if found[i] == "T" else 0
                if (tail, role[:1]) in legal:
                    add(extra, "K", ((role, text),), rest(i + 1, role[:1], 0))
                for r in roles:
                    add(extra + 1, "R", ((r, text),), rest(i + 1, r[0], 0))
        return min(ways, key=lambda w: w[:2]) if ways else None
    return rest(0, "", 0)


def digest_of(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute_report(rows):
    out, after = {}, damaged(rows)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest_of(*r[2:])))
        found = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        cost, letters, kept = cheapest(own, tuple(found))
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[found.count(f) for f in "BDT"],
                  sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])), cost, letters,
                  hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest())
    return out


def conversation_rows():
    rnd = random.Random(5)
    texts = ["a.", "b!", "c?", "d", "", " \n", "e.", "f.", "g. ", None, "long. " * 3000] + [f"text {k}." for k in range(12)] + ["x1", "x2"]
    roles = ["user", "assistant"] * 4 + ["system", "tool", None, "", "umpire"]
    rows = [(c, rnd.choice([None, k, k, k, k, k + rnd.randint(0, 5)]), rnd.choice(roles), rnd.choice(texts))
            for c in [None, *range(40)] for k in range(rnd.choice([1, 1, 2, 3, 5, 8, 12, 30]) if c != 7 else 150)]
    # runs that carry a cost vector through unchanged: truncated, blank; and equal rows of one turn
    rows += [(100, k, "user", "ok") for k in range(120)] + [(101, k, "user", "") for k in range(120)]
    rows += [(102, k, ["user", "assistant"][k % 2], f"fine {k}") for k in range(200)] + [(103, None, "user", "again.")] * 40
    return rows


@pytest.mark.parametrize("bits", [12, 1, 3])
def test_repair_brute_force(spark, bits):
    rows = conversation_rows()
    df = spark.createDataFrame([(*r, "x", 1, "k") for r in rows], "conv_id long, turn long, role string, text string, key string, pos int, k string")
    got = {r[0]: tuple(r[1:]) for r in conversation_repair.report(df, bits).collect()}
    assert got == brute_report(rows)


def test_repair_edits(spark):
    """The operator's own output: one row per edit, in order."""
    rows = [r for r in damaged(conversation_rows()) if r[0] in (7, 12, 102)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversation_repair.repair(df, 2).orderBy("key", "pos", "part").collect()
    for c in (7, 12, 102):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest_of(*r[2:])))
        _, letters, kept = cheapest(own, tuple(faults(own)))
        mine = [r for r in got if r["key"] == f"v{c}"]
        assert "".join(r["edit"] for r in mine) == letters
        assert [(r["role"], r["text"]) for r in mine if r["edit"] != "D"] == list(kept)


def test_repair_few_passes(spark, monkeypatch):
    """Rows that never make vectors meet are taken together in later passes."""
    passes = []
    kept = conversation_repair.materialize
    monkeypatch.setattr(conversation_repair, "materialize", lambda df, name: passes.append(name) or kept(df, name))
    rows = [(1, k, "user", "ok") for k in range(1500)] + [(1, 2000, "assistant", "end.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = conversation_repair.repair(df, 1).where("edit <> 'D'").collect()
    assert [r["edit"] for r in got] == []  # the lone answer goes too
    assert passes.count("conversation-pass") <= 4


def test_repair_empty_and_text_ids(spark):
    df = spark.createDataFrame([("urn:a", 0, "user", "hi."), ("urn:a", 1, "assistant", "yes."), (None, 0, "user", "hi.")],
                               "conv_id string, turn int, role string, text string")
    assert conversation_repair.report(df.where("false")).count() == 0
    assert conversation_repair.repair(df.where("false")).count() == 0
    got = {r["conv_id"]: r["audit"] for r in conversation_repair.report(df).collect()}
    assert set(got) == {"urn:a", None}
    kept = {(r["key"], r["edit"]) for r in conversation_repair.repair(df).collect()}
    assert ("vurn:a", "K") in kept


def test_repair_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in queries.QUERIES["op13_conversation_repair"](spark, SF).collect()}
    assert got == brute_report(rows)
