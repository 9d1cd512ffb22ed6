"""Ingest normalisation, text sink, length/language gates and the token cap."""
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import capping, filters, langid
from tessera.sources import textfiles


def test_normalize_doc(spark):
    r = spark.createDataFrame([("a\n\nb  c",)], "t string").select(T.normalize_doc("t").alias("n")).first()
    assert r.n == "a b c"


def test_text_sink_manifest_and_checksum(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "raw")
    df = spark.createDataFrame([(1, "hello"), (2, ""), (3, "world\nline")], "ord long, text string")
    m = textfiles.write_docs(df.repartition(3), out).first()
    assert (m.lines, m.empty_skipped) == (2, 1)
    parts = sorted(p for p in os.listdir(out) if p.startswith("part-"))
    content = "".join(open(os.path.join(out, p)).read() for p in parts)
    assert content == "hello\nworld line\n" and m.bytes == len(content.encode())
    sums = textfiles.file_checksums(spark, out + "/part-*").collect()
    assert all(len(r.sha256) == 64 for r in sums)


def test_length_gate(spark):
    df = spark.createDataFrame([(1, "x" * 100), (2, "x" * 250), (3, "x" * 100_001)], "id int, t string")
    kept = [r.id for r in df.where(filters.length_ok("t")).collect()]
    assert kept == [2]


def test_language_gate_with_stub_detector(spark):
    df = spark.createDataFrame([(1, "x" * 250 + " english text"), (2, "x" * 250 + " other")], "id int, t string")
    stub = F.col("t").endswith("english text")
    kept = [r.id for r in filters.gate(df, "t", english=stub).collect()]
    assert kept == [1]


def test_trigram_model_separates_languages(spark):
    train = spark.createDataFrame(
        [("en", "the cat sat on the mat and the dog ate the bone " * 8),
         ("de", "der hund und die katze sind nicht auf der matte " * 8)], "lang string, text string")
    prof = langid.profiles(train)
    docs = spark.createDataFrame([(1, "the dog and the cat sat on the mat " * 10),
                                  (2, "die katze und der hund sind auf der matte " * 10),
                                  (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.english(docs, prof).collect()}
    assert got[1].is_english and got[1].pred_lang == "en"
    assert not got[2].is_english and got[2].pred_lang == "de"
    assert not got[3].is_english and got[3].p_en is None


def test_token_cap_exact(spark):
    docs = spark.createDataFrame([(i, "d") for i in range(50)], "doc_id long, text string")
    res = capping.capped_prefix(docs, "doc_id", F.lit(True), F.lit(10), token_cap=35, batch_docs=5)
    st = res.stats.first()
    assert st.tokens == 35 and st.hit_cap and st.docs_kept == 5 and st.docs_seen == 5
    assert st.tokens * 4 == 140
    kept = res.docs.orderBy("doc_id").collect()
    assert [r.tokens_kept for r in kept] == [10, 10, 10, 5, 0]


def test_token_cap_not_reached_consumes_stream(spark):
    docs = spark.createDataFrame([(i, "d") for i in range(7)], "doc_id long, text string")
    st = capping.capped_prefix(docs, "doc_id", F.col("doc_id") != 3, F.lit(2), 1000, 5).stats.first()
    assert (st.docs_seen, st.docs_kept, st.docs_dropped, st.tokens, st.hit_cap) == (7, 6, 1, 12, False)


def test_cap_must_be_positive(spark):
    docs = spark.createDataFrame([(1, "d")], "doc_id long, text string")
    with pytest.raises(ValueError):
        capping.capped_prefix(docs, "doc_id", F.lit(True), F.lit(1), 0, 5)


def test_language_gate_has_no_bound_on_languages(spark):
    rows = [(f"l{k:04d}", f"{k:04d} {k * 7919 % 10007:05d}") for k in range(1200)] + [("en", "the quick brown fox")]
    prof = langid.profiles(spark.createDataFrame(rows, "lang string, text string"))
    docs = spark.createDataFrame([(1, "the quick brown fox"), (2, rows[1100][1]), (3, "ab"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.english(docs, prof).collect()}
    assert got[1].pred_lang == "en" and got[1].is_english
    assert got[2].pred_lang == "l1100" and not got[2].is_english
    assert all(got[k].pred_lang is None and not got[k].is_english for k in (3, 4))


def test_language_gate_sent_or_joined(spark, monkeypatch):
    """A profile too large for the workers gives the same languages by a join; nulls, long texts."""
    rows = [("en", "the quick brown fox jumps over the lazy dog"), ("de", "der schnelle braune fuchs springt"),
            ("fr", "le rapide renard brun saute"), (None, "zzz yyy xxx"), ("e2", None)]
    prof = langid.profiles(spark.createDataFrame(rows, "lang string, text string"))
    docs = spark.createDataFrame([(1, "the fox \U0001f600 is lazy"), (2, "der Fuchs"), (3, "renard " * 2000), (4, ""), (5, None),
                                  (6, "q?!"), (7, "zzz")], "doc_id long, text string")
    sent = {r.doc_id: r for r in langid.english(docs, prof).collect()}
    monkeypatch.setattr(langid, "CELLS_AT_ONCE", 7)
    small = {r.doc_id: r for r in langid.english(docs, prof).collect()}
    assert sent == small
    plan = langid.english(docs, prof)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Cartesian" not in plan
    monkeypatch.setattr(langid, "MAX_CELLS", 0)
    joined = {r.doc_id: r for r in langid.english(docs, prof).collect()}
    for k, r in sent.items():
        assert (r.pred_lang, r.is_english) == (joined[k].pred_lang, joined[k].is_english)
        assert (r.p_en is None) == (joined[k].p_en is None)
        assert r.p_en is None or abs(r.p_en - joined[k].p_en) < 1e-9
    empty = langid.profiles(spark.createDataFrame([], "lang string, text string"))
    monkeypatch.undo()
    assert all(not r.is_english for r in langid.english(docs, empty).collect())


def test_profiles_are_counted_before_any_trigram_is_a_row(spark, monkeypatch):
    from collections import Counter
    from tessera.operators import langid
    texts = [("en", "The cat, THE cat"), ("en", "ab"), ("en", None), ("de", "\U0001f600\U0001f600x\u00c4\ue000\uffff end"), (None, "the cat"), ("de", "")]
    docs = spark.createDataFrame(texts, "lang string, text string")
    exp = Counter((lang, t.lower()[k:k + 3]) for lang, t in texts if t for k in range(len(t) - 2))
    for at_once in (5, 1 << 22):
        monkeypatch.setattr(langid, "GRAMS_AT_ONCE", at_once)
        prof = langid.profiles(docs)
        assert {(r.lang, r.gram): r.cnt for r in prof.collect()} == exp
    assert prof.columns == ["lang", "gram", "cnt"]
    assert "explode" not in prof._jdf.queryExecution().optimizedPlan().toString()
