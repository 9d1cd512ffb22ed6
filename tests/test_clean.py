"""Clean + dedupe expectations carried over from the reference tests."""
import hashlib
import os

import pytest

from tessera.functions import text as T
from tessera.operators import dedupe
from tessera.sources import textfiles


def test_clean_line_cases(spark):
    cases = ["  hello\x00  world\t\n", "", "   \n", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = [r.c for r in df.select("i", T.clean_line("t").alias("c")).orderBy("i").collect()]
    assert got == ["hello world", "", "", ""]


def test_digest_is_sha1(spark):
    r = spark.createDataFrame([("hello world",)], "t string").select(T.digest("t").alias("d")).first()
    assert r.d == hashlib.sha1(b"hello world").hexdigest() and len(r.d) == 40


def test_dedupe_two_files_first_wins(spark, tmpdir_path):
    a = os.path.join(tmpdir_path, "a.txt")
    b = os.path.join(tmpdir_path, "b.txt")
    with open(a, "w") as f:
        f.write("Hello World\nhello world\n\nfoo\n")
    with open(b, "w") as f:
        f.write("foo\nbar\n")
    lines = textfiles.read_lines(spark, [a, b])
    cleaned = dedupe.clean(lines.select("ord", "text"), normalise_first=False)
    kept = dedupe.first_per_digest(cleaned).orderBy("ord").collect()
    assert [r.text for r in kept] == ["Hello World", "hello world", "foo", "bar"]
    st = dedupe.dedupe_stats(cleaned).first()
    assert (st.input_lines, st.empty_dropped, st.duplicates_dropped, st.kept) == (6, 1, 1, 4)
    assert st.dedupe_ratio == pytest.approx(1 / 5)


def test_text_sink_refuses_overwrite(spark, tmpdir_path):
    out = os.path.join(tmpdir_path, "out")
    df = spark.createDataFrame([(1, "x")], "ord long, text string")
    textfiles.write_docs(df, out)
    with pytest.raises(Exception):
        textfiles.write_docs(df, out)
    textfiles.write_docs(df, out, force=True)


def test_canonical_equals_reference_composition(spark):
    import regex as re
    ctrl = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]+")
    ws = re.compile(r"\s+")

    def ref(t):
        t = " ".join(t.split())
        return ws.sub(" ", ctrl.sub("", t)).strip() if t else ""

    chars = [chr(i) for i in range(0x3100) if not 0xD800 <= i <= 0xDFFF]
    samples = ["".join(chars[i:i + 37]) for i in range(0, len(chars), 11)]
    samples += ["a \x00 b", "\x1c\x85x\x0b\x00 \ty", " \x01 ", " z　"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", T.canonical_text("t").alias("c")).collect()}
    assert all(got[i] == ref(s) for i, s in enumerate(samples))


def test_first_lines_are_the_first_survivors(spark):
    rows = [(k if k % 9 else None, f"  line {k % 17} " if k % 4 else " ") for k in range(60)] + [(5, "line 5"), (5, "line 5"), (7, "other")]
    docs = spark.createDataFrame(rows, "ord long, text string")
    every = dedupe.first_per_digest(dedupe.clean(docs)).orderBy("ord").collect()
    for n in (1, 3, 100):
        got = dedupe.first_lines(docs, n)
        kept = sorted(got.collect(), key=lambda r: (r.ord, r.text))
        if n in (1, 3):
            assert [r.ord for r in kept] == [r.ord for r in every[:n]]
        else:
            assert sorted((r.ord, r.text) for r in kept) == sorted((r.ord, r.text) for r in every)
