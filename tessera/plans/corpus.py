"""L1/L2/L3: the corpus build as a chain of table-to-table jobs.

Steps (any subset, in this order; each yields tables and a small metrics dict):

  clean_dedupe  P1 + sha1 + first-occurrence dedupe across sources (D1, D2)
  bpe           word counts of the deduplicated corpus -> vocab, merges, word symbols (A4-A6),
                round-trip gate on the first 1000 lines (A7, F6)
  tokenize      cleaned, *non-deduplicated* docs per source -> BPE ids + EOS -> packed chunks (L2)
  split         95/5 token split of the chosen shards (W4) and manifest upsert (J5)
  stream_cap    language/length-gated docs, token-capped prefix appended as its own shard (W2)
  verify        one smoke batch with the shift check (M5, P18)

Only one-row metrics and the (bounded) vocabulary pass through the driver. Writing the tables
out (with refuse / overwrite / skip rules) is ``sources.artifacts``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import bpe, capping, dedupe, filters, shards
from tessera.operators import windows as W
from tessera.operators.keys import join_null_safe
from tessera.operators.materialize import materialize
from tessera.sources import tables

_MODELS: dict[tuple, bpe.BpeModel] = {}


def bpe_model(spark: SparkSession, sf_dir: str, vocab_size: int, min_frequency: int = 2) -> bpe.BpeModel:
    """Train (once per session and input) and keep the vocabulary tables, as the reference trains
    once and reloads ``vocab.json``/``merges.txt`` afterwards."""
    key = (spark.sparkContext.applicationId, sf_dir, vocab_size, min_frequency)
    if key not in _MODELS:
        docs = tables.documents(spark, sf_dir, "doc_id", "text", "ord")
        cleaned = dedupe.first_per_digest(dedupe.clean(docs))
        wc = bpe.word_counts(cleaned.select("text"))
        m = bpe.train(wc, vocab_size=vocab_size, min_frequency=min_frequency)
        m.vocab = materialize(m.vocab, "bpe_vocab")
        m.merges = materialize(m.merges, "bpe_merges")
        _MODELS[key] = m
    return _MODELS[key]


def tokenize_sources(docs: DataFrame, model: bpe.BpeModel, shard_col: str = "source",
                     chunk_size: int = shards.CHUNK_SIZE) -> DataFrame:
    """Clean (no dedupe), drop empty, BPE-encode with EOS, pack per shard into chunks —
    word by word, so no document is ever one array or one group."""
    c = docs.where(T.has_content("text")).select(
        F.col(shard_col).alias("shard"), F.col("doc_id").alias("ord"), T.canonical_text("text").alias("text"))
    pieces = bpe.encode_pieces(c, model)
    if model.vocab_size <= 1 << 15:  # half the bytes in the shuffle
        pieces = pieces.withColumn("ids", F.col("ids").cast("array<smallint>"))
    return shards.pack_pieces(pieces, chunk_size)


@dataclass
class BuildResult:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    stats: dict[str, dict] = field(default_factory=dict)


def build(spark: SparkSession, sf_dir: str, vocab_size: int = 300, split_shards: tuple[str, ...] | None = ("en",),
          train_frac: float = 0.95, token_cap: int | None = None, batch_docs: int = 50,
          smoke_context: int = 128, smoke_batch: int = 4, seed: int = 42,
          steps: tuple[str, ...] = ("clean_dedupe", "bpe", "tokenize", "split", "stream_cap", "verify")
          ) -> BuildResult:
    """L1: run the selected steps in order; each step's metrics row is collected (one row).
    ``split_shards`` None splits every shard."""
    from tessera.operators import sampling as SM
    out = BuildResult()
    docs = tables.documents(spark, sf_dir, "doc_id", "source", "lang", "text", "ord")
    if "clean_dedupe" in steps:
        cl = dedupe.clean(docs)
        out.tables["docs_clean"] = dedupe.first_per_digest(cl)
        out.stats["clean_dedupe"] = dedupe.dedupe_stats(cl).first().asDict()
    model = None
    if "bpe" in steps:
        model = bpe_model(spark, sf_dir, vocab_size)
        out.tables["vocab"] = model.vocab
        out.tables["merges"] = model.merges
        sample = dedupe.first_lines(docs.select("ord", "text"), 1000)
        rt = bpe.check_roundtrip(bpe.roundtrip(sample, model, 1000))
        out.stats["bpe"] = {"vocab_size": model.vocab_size, "rounds": model.rounds, **rt}
    chunks = None
    if "tokenize" in steps and model is not None:
        chunks = tokenize_sources(docs, model)
        meta = shards.shard_meta(chunks)
        filters.require(meta.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] > 0, "no tokens written")
        out.tables["token_chunks"] = chunks
        out.tables["shard_meta"] = meta
    if "split" in steps and chunks is not None:
        meta = out.tables["shard_meta"]
        chosen = F.lit(True) if split_shards is None else F.coalesce(F.col("shard").isin(*split_shards), F.lit(False))
        counts = shards.split_counts(meta.where(chosen), train_frac)
        parts = shards.split_chunks(chunks.where(chosen), counts)
        rest = chunks.where(~chosen)
        chunks = materialize(rest.unionByName(parts), "token_chunks_split")
        out.tables["token_chunks"] = chunks
        out.tables["shard_meta"] = shards.upsert_meta(meta, shards.shard_meta(parts))
        out.stats["split"] = {r["shard"]: r.asDict() for r in counts.collect()}
    if "stream_cap" in steps and model is not None:
        prof_docs = docs.select("doc_id", "lang", "text")
        from tessera.operators import langid
        prof = materialize(langid.profiles(prof_docs), "lang_profiles")
        eng = langid.english(prof_docs, prof)
        gated = docs.join(eng.select("doc_id", "is_english"), "doc_id")
        passed = (filters.drop_reason("text", F.col("is_english")) == "kept")
        enc = bpe.encode(gated.where(passed).select("doc_id", "text"), model, eos=True)
        stream = gated.join(enc, "doc_id", "left")
        n_tok = F.coalesce(F.size("ids"), F.lit(0))
        cap = token_cap or max(1, int(stream.where(passed).agg(F.sum(n_tok)).first()[0] or 0) // 2)
        res = capping.capped_prefix(stream, "doc_id", passed, n_tok, cap, batch_docs, keep=["ids"])
        out.stats["stream_cap"] = res.stats.first().asDict()
        kept = res.docs.select("doc_id", F.lit("capped").alias("shard"), F.col("doc_id").alias("ord"),
                               F.slice("ids", 1, F.col("tokens_kept").cast("int")).alias("ids"))
        out.tables["capped_chunks"] = shards.to_chunks(shards.pack_offsets(kept))
    if "verify" in steps and chunks is not None:
        meta_row = out.tables["shard_meta"].orderBy(F.desc("tokens")).first().asDict()
        s = SM.single_shard_samples(spark, meta_row, smoke_context, seed, num_samples=smoke_batch)
        w = W.with_shift(W.fetch(s, chunks, smoke_context + 1, shards.CHUNK_SIZE, key="i"), smoke_context)
        v = w.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(W.valid(smoke_context), 1)).alias("valid")).first()
        filters.require(v["rows"] == smoke_batch and v["valid"] == smoke_batch, "smoke batch failed")
        out.stats["verify"] = {"shape": [smoke_batch, smoke_context], "shard": meta_row["shard"]}
    return out


def diagnose(train_chunks: DataFrame, val_chunks: DataFrame, context: int, vocab_size: int,
             batch_size: int = 4, max_batches: int = 50, suffix: str | None = None) -> DataFrame:
    """L3: capped and full evaluation plus vocabulary usage of the validation shard, one JSON row
    per validation shard."""
    from tessera.operators import evaluate as EV
    vmeta = materialize(shards.shard_meta(val_chunks), "val_meta")
    pairs = materialize(EV.bigram_counts(train_chunks)[0], "bigrams")  # both evaluations read them
    fitted = pairs, pairs.groupBy("shard", "prev").agg(F.sum("c").alias("cp"))
    capped = EV.evaluate(train_chunks, val_chunks, vmeta, context, vocab_size, batch_size, max_batches, suffix=suffix, fitted=fitted)
    full = EV.evaluate(train_chunks, val_chunks, vmeta, context, vocab_size, batch_size, None, suffix=suffix, fitted=fitted)
    usage = shards.vocab_usage(val_chunks, vocab_size)
    summary = F.struct("val_loss", "val_ppl", "val_tokens")
    used = usage.select("shard", F.struct("vocab_size", "unique_ids", "coverage_pct", "min_id", "max_id").alias("vocab_usage"))
    j = join_null_safe(capped.select("shard", summary.alias("capped")), full.select("shard", summary.alias("full")), ["shard"])
    j = join_null_safe(j, used, ["shard"])
    return j.select("shard", "capped", "full", "vocab_usage",
                    F.to_json(F.struct("capped", "full", "vocab_usage")).alias("report"))

