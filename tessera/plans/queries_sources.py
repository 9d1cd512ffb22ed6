"""Queries for sources and sinks: what a writer stored is read back and compared with the tables.

Each run writes into new folders under the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import bytelevel as BL
from tessera.functions import text as T
from tessera.operators import shards
from tessera.operators.keys import join_null_safe
from tessera.operators.order import with_ordinal
from tessera.plans import sql as S
from tessera.plans.queries import _BYTE_DOCS_SQL, _PACK_SQL, CHUNK, _chunks, query
from tessera.session import shared_dir
from tessera.sources import artifacts, tables, textfiles, tokenbin
from tessera.streaming.common import table_stream, to_parquet


# --- S1: one text field of a table, null rows dropped -----------------------------------------------
@query("corpus_scan", """
SELECT page_id, md5(html) AS text_md5, length(html)::BIGINT AS n_chars FROM pages WHERE html IS NOT NULL""")
def q_corpus_scan(spark, d):
    docs = tables.corpus_scan(tables.table(spark, d, "pages", "page_id", "html"), "html", "page_id")
    return docs.select("page_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"),
                       F.char_length("text").cast("bigint").alias("n_chars"))


# --- S2 S4 A1: named ingest, counters of the sink ------------------------------------------------------
_LINES_SQL = f"""
WITH n AS (SELECT doc_id, {S.normalize_doc('text')} AS line FROM documents WHERE text IS NOT NULL)"""


def _ingest(spark, d):
    docs = tables.table(spark, d, "documents", "doc_id", "text")
    path = shared_dir(spark, "corpus-text")
    return path, artifacts.ingest(docs, path, "doc_id")


@query("ingest_manifest", _LINES_SQL + """
SELECT count(*) FILTER (WHERE line <> '')::BIGINT AS lines, count(*) FILTER (WHERE line = '')::BIGINT AS empty_skipped,
       coalesce(sum(octet_length(encode(line)) + 1) FILTER (WHERE line <> ''), 0)::BIGINT AS bytes FROM n""")
def q_ingest_manifest(spark, d):
    return _ingest(spark, d)[1].drop("path")


# --- S3: the written lines in file order --------------------------------------------------------------
@query("line_scan", _LINES_SQL + """
SELECT row_number() OVER (ORDER BY doc_id)::BIGINT AS line_no, md5(line) AS line_md5 FROM n WHERE line <> ''""")
def q_line_scan(spark, d):
    lines = textfiles.read_lines(spark, [_ingest(spark, d)[0]]).select("ord.file_path", "ord.block", "ord.line", "text")
    numbered = with_ordinal(lines, ["file_path", "block", "line"], "line_no")
    return numbered.select("line_no", F.md5(F.encode("text", "UTF-8")).alias("line_md5"))


# --- S12 S13: size and digest of every file, one file a benchmark item; a second write changes nothing -----
@query("file_checksums", f"""
WITH n AS (SELECT item_id, {S.normalize_doc('text')} AS line FROM benchmark)
SELECT item_id, (octet_length(encode(line)) + 1)::BIGINT AS bytes, sha256(line || chr(10)) AS sha256 FROM n WHERE line <> ''""")
def q_file_checksums(spark, d):
    items = tables.table(spark, d, "benchmark", "item_id", "text").select("item_id", T.normalize_doc("text").alias("line"))
    items = items.where("line <> ''").repartition("item_id")
    path = shared_dir(spark, "items")
    for mode in (textfiles.save_mode(), textfiles.save_mode(skip_existing=True)):
        items.write.mode(mode).partitionBy("item_id").text(path)
    files = textfiles.file_checksums(spark, f"{path}/item_id=*/part-*")
    item = F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("bigint")
    return files.select(item.alias("item_id"), "bytes", "sha256")


# --- S6 S7: shard table written, read, the later half of the documents appended ----------------------------
_CHUNK_ROWS_SQL = _PACK_SQL + f""",
tok AS (SELECT b.shard, pk.start + generate_subscripts(b.ids, 1) - 1 AS pos, unnest(b.ids) AS id
        FROM b JOIN pk USING (doc_id)),
ch AS (SELECT shard, (pos // {CHUNK})::BIGINT AS chunk_id, count(*)::INTEGER AS n_ids, sum(id)::BIGINT AS sum_ids,
              arg_min(id, pos)::INTEGER AS first_id, arg_max(id, pos)::INTEGER AS last_id FROM tok GROUP BY 1, 2)"""


def _chunk_rows(chunks):
    return chunks.select("shard", "chunk_id", F.size("ids").alias("n_ids"),
                         F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_ids"),
                         F.element_at("ids", 1).alias("first_id"), F.element_at("ids", -1).alias("last_id"))


@query("shard_append", _CHUNK_ROWS_SQL + "\nSELECT * FROM ch")
def q_shard_append(spark, d):
    docs = tables.documents(spark, d, "doc_id", "lang", "text").where(T.has_content("text"))
    mid = docs.agg(F.expr("(max(doc_id) + 1) div 2")).first()[0]
    pieces = BL.raw_pieces(
        docs.select(F.col("lang").alias("shard"), F.col("doc_id").alias("ord"), T.canonical_text("text").alias("text")),
        piece_chars=shards.PIECE_CHARS, eos_piece=shards.EOS_PIECE)
    path = shared_dir(spark, "shards")
    artifacts.write_shards(shards.pack_pieces(pieces.where(F.col("ord") < mid), CHUNK), path)
    stored = spark.read.parquet(path)
    return _chunk_rows(artifacts.append_pieces(stored, shards.shard_meta(stored), pieces.where(F.col("ord") >= mid), CHUNK))


# --- S8 S9 S11 P15: the .bin parts of each shard, read back; tokens from the size of the file ----------------------
@query("bin_roundtrip", _CHUNK_ROWS_SQL + """,
m AS (SELECT shard, sum(n_tokens)::BIGINT AS file_tokens FROM pk GROUP BY shard)
SELECT ch.*, m.file_tokens FROM ch JOIN m USING (shard)""")
def q_bin_roundtrip(spark, d):
    chunks = _chunks(spark, d)
    folder = shared_dir(spark, "bin")
    names = [r["shard"] for r in chunks.select("shard").distinct().orderBy("shard").collect()]
    paths = {shard: f"{folder}/{k}.bin" for k, shard in enumerate(names)}
    for shard, path in paths.items():
        tokenbin.write_parts(chunks.where(F.col("shard").eqNullSafe(shard)), path)
    stored = artifacts.concat([tokenbin.read_bin(spark, p, None, CHUNK).withColumn("shard", F.lit(s).cast("string"))
                               for s, p in paths.items()])
    meta = tokenbin.meta_from_files(spark, paths).select("shard", F.col("tokens").alias("file_tokens"))
    return join_null_safe(_chunk_rows(stored), meta, ["shard"])


# --- S10: manifest saved and loaded ---------------------------------------------------------------------
@query("manifest_roundtrip", _BYTE_DOCS_SQL + """
SELECT shard, sum(len(ids))::BIGINT AS tokens, 'int32' AS dtype FROM b GROUP BY shard""")
def q_manifest_roundtrip(spark, d):
    path = shared_dir(spark, "manifest")
    artifacts.save_meta(shards.shard_meta(_chunks(spark, d)), path)
    return artifacts.load_meta(spark, path)


# --- U1: ordered concatenation of corpora -----------------------------------------------------------------
@query("concat_corpora", """
SELECT 0 AS src_rank, doc_id AS id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 1, page_id, md5(html) FROM pages WHERE html IS NOT NULL
UNION ALL SELECT 2, item_id, md5(text) FROM benchmark WHERE text IS NOT NULL""")
def q_concat_corpora(spark, d):
    scans = [tables.corpus_scan(tables.table(spark, d, name, key, text), text, key).withColumnRenamed(key, "id")
             for name, key, text in (("documents", "doc_id", "text"), ("pages", "page_id", "html"),
                                     ("benchmark", "item_id", "text"))]
    return artifacts.concat(scans).select("src_rank", "id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


# --- S5 P4: identified stream: id, else dump, else row index; every third id and every second dump is missing --
@query("stream_identified", """
SELECT coalesce(CASE WHEN doc_id % 3 <> 0 THEN 'urn:' || doc_id END, CASE WHEN doc_id % 2 <> 0 THEN source END,
                doc_id::VARCHAR) AS doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents""")
def q_stream_identified(spark, d):
    rows = table_stream(spark, f"{d.rstrip('/')}/documents.parquet").select(
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("urn:"), F.col("doc_id").cast("string"))).alias("id"),
        F.when(F.col("doc_id") % 2 != 0, F.col("source")).alias("dump"), F.col("doc_id").alias("row"), "text")
    out = tables.identified(rows, ["id", "dump"], "row")
    stored = spark.read.parquet(to_parquet(out, "identified"))
    return stored.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))
