"""Corpus artefacts as tables.

Every writer takes the reference's overwrite rule (refuse unless forced, or skip if present) as a
Spark save mode. Paths may be on any filesystem Spark can write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.operators import bpe, shards
from tessera.sources import tables, textfiles

META_SCHEMA = "shard string, tokens bigint, dtype string"


def concat(frames: list[DataFrame]) -> DataFrame:
    """Ordered concatenation — each input gets its position as ``src_rank``."""
    out = None
    for rank, df in enumerate(frames):
        d = df.withColumn("src_rank", F.lit(rank))
        out = d if out is None else out.unionByName(d)
    if out is None:
        raise ValueError("no inputs")
    return out


def ingest(source: DataFrame, out_dir: str, ord_col: str, text_field: str = "text",
           force: bool = False) -> DataFrame:
    """S1+S2+S4: one named corpus -> normalised one-document-per-line text; returns the manifest
    row (path, lines, empty_skipped, bytes). ``ord_col`` gives the order of the lines: Spark splits
    carry none of their own (for text files it is the ``ord`` of ``textfiles.read_lines``)."""
    docs = tables.corpus_scan(source, text_field, ord_col)
    return textfiles.write_docs(docs, out_dir, "text", ord_col, force=force)


def write_shards(chunks: DataFrame, path: str, force: bool = False, skip_existing: bool = False) -> None:
    """Chunk table partitioned by shard, in ranges of ``(shard, chunk_id)``: a shard of any size
    is written by many tasks, and offset reads skip files and row groups by ``chunk_id``."""
    (chunks.repartitionByRange("shard", "chunk_id").sortWithinPartitions("shard", "chunk_id")
     .write.mode(textfiles.save_mode(force, skip_existing)).partitionBy("shard").parquet(path))


def append_tokens(chunks: DataFrame, meta: DataFrame, pieces: DataFrame,
                  chunk_size: int = shards.CHUNK_SIZE) -> DataFrame:
    """Append ``pieces(shard, ord, ids)`` after the current end of their shard."""
    return append_pieces(chunks, meta, pieces.withColumn("piece", F.lit(0)), chunk_size)


def append_pieces(chunks: DataFrame, meta: DataFrame, pieces: DataFrame,
                  chunk_size: int = shards.CHUNK_SIZE) -> DataFrame:
    """S7 at piece level: append ``pieces(shard, ord, piece, ids or bytes)`` after the end of their shard.

    New pieces start at the shard's current token count (from ``meta``); only the shard's last,
    partial chunk is rebuilt together with the new pieces, full chunks are kept as they are."""
    cols = ["shard", "chunk_id", "start", "ids"]
    full = chunks.where(F.size("ids") == chunk_size).select(*cols)
    partial = chunks.where(F.size("ids") < chunk_size).select(*cols)
    return full.unionByName(shards.pack_pieces(pieces, chunk_size, after=meta, started=partial).select(*cols))


def save_meta(meta: DataFrame, path: str) -> None:
    """Manifest table, replaced atomically by the file commit protocol."""
    meta.select("shard", "tokens", "dtype").coalesce(1).write.mode("overwrite").json(path)


def load_meta(spark: SparkSession, path: str) -> DataFrame:
    """Manifest table; empty when missing."""
    try:
        return spark.read.schema(META_SCHEMA).json(path)
    except AnalysisException:
        return spark.createDataFrame([], META_SCHEMA)


def save_vocab(model: bpe.BpeModel, out_dir: str, force: bool = False) -> None:
    """``vocab`` (token, id) as JSON lines and ``merges`` as ``left right`` text lines in rank
    order; both bounded by the vocabulary size."""
    mode = textfiles.save_mode(force)
    model.vocab.coalesce(1).write.mode(mode).json(f"{out_dir}/vocab")
    (model.merges.orderBy("rank").select(F.concat_ws(" ", "left", "right").alias("v"))
     .coalesce(1).write.mode(mode).text(f"{out_dir}/merges"))


def load_vocab(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vocabulary with missing special tokens appended, merges with their rank."""
    vocab = bpe.ensure_specials(spark.read.schema("token string, id int").json(f"{out_dir}/vocab"))
    n = vocab.count()
    if n > bpe.MAX_BROADCAST_VOCAB:
        raise ValueError(f"vocabulary of {n} tokens above the broadcast bound")
    lines = textfiles.read_lines(spark, [f"{out_dir}/merges"])
    parts = F.split("text", " ")
    # merges hold at most vocab_size rows: a single ordered window over them is fine
    merges = lines.select((F.row_number().over(Window.orderBy("ord")) - 1).cast("int").alias("rank"),
                          F.element_at(parts, 1).alias("left"), F.element_at(parts, 2).alias("right"))
    ids = vocab.select(F.col("token").alias("_t"), F.col("id"))
    merges = merges.join(F.broadcast(ids), F.concat("left", "right") == F.col("_t"), "left").drop("_t")
    return vocab, merges


def export_jsonl(records: DataFrame, out_dir: str, json_col: str = "json", force: bool = False) -> None:
    """One JSON object per line (non-ASCII kept as is)."""
    records.select(json_col).write.mode(textfiles.save_mode(force)).text(out_dir)

