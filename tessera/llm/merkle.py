"""3. Document fingerprints: a Merkle tree over the paragraphs and sections of a text.

Paragraphs are lines, cut further into pieces at punctuation (and after 64 characters without
any), and up to eight paragraphs, or those up to an empty line, are a section. A node's hash is
taken over its children's hashes; the root is over the sections. Equal roots mean equal texts;
otherwise branches with equal hashes are skipped and the others are walked down to the pieces
that differ.

The fingerprint is text: the root, then the sections split by ``/``, their paragraphs by ``,``,
and in a paragraph 8 hex digits for each piece. Inner hashes follow from it.

The digest query needs each document next to its successor. Documents are dealt out by ranges of
their ids once and walked in order; a range's last row meets the next range's first row through a
join of those edge rows alone (two per range).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import prepare
from tessera.operators.order import with_bucket

_PIECE = re.compile(r"[^.,;:!?|]{1,64}[.,;:!?|\s]*|[.,;:!?|]+")
SECTION = 8
#: Bytes of text a task walks, and the most tasks that are cut for it (beyond, a task walks more).
RANGE_BYTES, MAX_PARTS = 64 << 20, 16384
_hash = xxhash.xxh64_hexdigest


def sections(text: str) -> list[list[str]]:
    """Sections of a text as lists of paragraphs; joined by newlines they give the text."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if len(out[-1]) == SECTION or (out[-1] and not line):
            out.append([])
        out[-1].append(line)
    return out


def fingerprint(text: str) -> str:
    """Root (16 hex digits of the tree's top hash, 16 of the whole text's) and tree."""
    tree, tops = [], []
    for section in sections(text):
        leaves = ["".join([_hash(p)[:8] for p in _PIECE.findall(line)]) for line in section]
        tree.append(",".join(leaves))
        tops.append(_hash(",".join([_hash(x) for x in leaves])))
    root = _hash("/".join(tops)) + hashlib.blake2b(text.encode(), digest_size=8).hexdigest()
    return root + ":" + "/".join(tree)


def _leaves(tree: str) -> list[str]:
    return [p[k:k + 8] for s in tree.split("/") for p in s.split(",") for k in range(0, len(p), 8)]


def _unequal(a: str, b: str) -> tuple[int, list[str], list[str]]:
    """Pieces in sections that both trees hold, and the sections that one of them lacks."""
    x, y = a.split("/"), b.split("/")
    left, right = Counter(x), Counter(y)
    both = left & right
    same = sum((len(s) - s.count(",")) // 8 * n for s, n in both.items())
    return same, list((left - both).elements()), list((right - both).elements())


def likeness(a: str, b: str) -> float:
    """Share of pieces that two fingerprints have in common, 0 to 1; 1 if the roots are equal."""
    if a[:32] == b[:32]:
        return 1.0
    a, b = a[33:], b[33:]
    same, x, y = _unequal(a, b)
    p, q = Counter(_leaves("/".join(x))), Counter(_leaves("/".join(y)))
    total = 2 * same + p.total() + q.total()
    return 2 * (same + (p & q).total()) / total if total else 0.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) numbers of ``b`` whose branch is not in ``a``."""
    if a[:32] == b[:32]:
        return []
    known = Counter(a[33:].split("/"))
    paragraphs = Counter(p for s in a[33:].split("/") for p in s.split(","))
    out = []
    for i, s in enumerate(b[33:].split("/")):
        if known[s] > 0:
            known[s] -= 1
            continue
        for j, p in enumerate(s.split(",")):
            if paragraphs[p] > 0:
                paragraphs[p] -= 1
            else:
                out.append((i, j))
    return out


def fingerprints(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """``docs`` with a fingerprint column. A null text is an empty one (one empty paragraph)."""
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def of(texts):
        return texts.fillna("").map(fingerprint)

    return docs.withColumn(out_col, of(F.col(text_col)))


def _row(doc_id, text: str, fp: str, after: str, after_fp: str) -> tuple:
    half = len(text) // 2
    edited = text[:len(text) - half] + after[:half]
    edited_fp = fp if edited == text else fingerprint(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), fp, edited_fp,
            likeness(fp, edited_fp), likeness(fp, after_fp))


_FIELDS = [pa.field("n_chars", pa.int64()), pa.field("edited_sha256", pa.string()),
           pa.field("fingerprint", pa.string()), pa.field("edited_fingerprint", pa.string()),
           pa.field("near_edited", pa.float64()), pa.field("near_next", pa.float64())]


def _schema(batch: pa.RecordBatch) -> pa.Schema:
    return pa.schema([pa.field("_id", batch.schema.field("_id").type), *_FIELDS])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row of a sorted range with the row after it; a range's last row has none here."""
    held = at = None
    for batch in batches:
        out = []
        for part, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("_range", "_id", "_text"))):
            fp = fingerprint(text)
            if held and part == at:
                out.append(_row(*held, text, fp))
            held, at = (doc_id, text, fp), part
        yield _batch(out, _schema(batch))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last row of each range, marked 0 and 1."""
    held = None
    for batch in batches:
        parts = batch.column("_range").to_pylist()
        for k, part in enumerate(parts):
            row = None
            if held is None or held[0] != part:
                if held:
                    yield _marked(held[1], 1)
                row = batch.slice(k, 1)
                yield _marked(row, 0)
            if k + 1 == len(parts) or parts[k + 1] != part or row is not None:
                held = (part, row or batch.slice(k, 1))
    if held:
        yield _marked(held[1], 1)


def _marked(row: pa.RecordBatch, edge: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*row.columns, pa.array([edge], pa.int32())], names=[*row.schema.names, "_edge"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([_row(i, t, fingerprint(t), n, fingerprint(n)) for i, t, n in
                      zip(*(batch.column(c).to_pylist() for c in ("_id", "_text", "_after")))], _schema(batch))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness (see the contract of
    ``op3``). Ids may be numbers, times or texts (ordered by their bytes). Null ids come first; rows with equal ids follow each other in the order of their
    texts, so repeated rows are each other's successors. A single row is its own successor. An
    empty table gives an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = base.schema["_id"].dataType.simpleString()
    # ranges of ids, more of them for more text: cut points are one number per range
    size = base.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism,
                min(MAX_PARTS, math.ceil(size / RANGE_BYTES)))
    place = with_bucket(base, "_id", 4 * parts).withColumnRenamed("_bkt", "_range")
    ordered = (place.select("_range", "_id", "_text").repartition(parts, "_range")
               .sortWithinPartitions("_range", "_id", "_text"))
    columns = (f"_id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
               "edited_fingerprint string, near_edited double, near_next double")
    inner = ordered.mapInArrow(_pairs, columns)
    edges = ordered.mapInArrow(_edges, f"_range int, _id {kind}, _text string, _edge int")
    lasts = edges.where("_edge = 1").select("_range", "_id", "_text")
    firsts = edges.where("_edge = 0").select(F.col("_range").alias("_next"), F.col("_text").alias("_after"))
    following = Window.orderBy("_range")  # one row per range
    chain = edges.where("_edge = 0").select("_range")
    chain = chain.select("_range", F.coalesce(F.lead("_range").over(following),
                                              F.min("_range").over(Window.partitionBy())).alias("_next"))
    meeting = lasts.join(chain, "_range").join(firsts, "_next").select("_id", "_text", "_after")
    out = inner.unionByName(meeting.mapInArrow(_meet, columns))
    return out.withColumnRenamed("_id", id_col)
