"""Byte-level BPE as DataFrame jobs.

Training (``bpe_train``) works on the distinct words in rounds of many merges. Encoding holds the
merge ranks in each worker, broadcast after a check of their number, and encodes Arrow batches of
words in place: the distinct words of a batch once each, with a bounded dictionary of words seen
before. No word is shuffled.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import bytelevel as BL
from tessera.functions import text as T
from tessera.operators.bpe_train import merge_ids, train_tables
from tessera.operators.materialize import materialize

MAX_BROADCAST_VOCAB = 1_000_000
#: Words of one encoded piece of a text; distinct words that a worker remembers.
PIECE_WORDS, REMEMBERED = 1024, 400_000
#: Rows whose words are encoded at once.
ROWS_AT_ONCE = 256


# ---------------------------------------------------------------------------
# A4 / A5
# ---------------------------------------------------------------------------
def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A4: pre-token frequencies ``(word, cnt)``."""
    return (docs.select(F.explode(T.words(text_col)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).cast("bigint").alias("cnt")))


def symbol_words(wc: DataFrame) -> DataFrame:
    """Add ``sy``: the word's byte-level characters joined by spaces."""
    return wc.withColumn("sy", BL.symbols(BL.to_byte_level("word")))


def _pairs(sy: Column) -> Column:
    """Adjacent symbol pairs as ``array<struct<left, right>>`` (two shifted slices zipped; no
    lambda refers back to the whole array, which would re-split it per element)."""
    arr = F.split(sy, " ")
    n = F.greatest(F.size(arr) - 1, F.lit(0))
    return F.arrays_zip(F.slice(arr, 1, n).alias("left"), F.slice(arr, 2, n).alias("right"))


def pair_counts(words: DataFrame, sy: str = "sy", cnt: str = "cnt") -> DataFrame:
    """A5: ``(left, right, cnt)`` adjacent pair counts weighted by word count."""
    multi = words.where(F.col(sy).contains(" "))
    p = multi.select(F.col(cnt), F.explode(_pairs(F.col(sy))).alias("p"))
    return p.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")) \
        .agg(F.sum(cnt).cast("bigint").alias("cnt"))


# ---------------------------------------------------------------------------
# A6
# ---------------------------------------------------------------------------
@dataclass
class BpeModel:
    vocab: DataFrame        # (token string, id int)
    merges: DataFrame       # (rank int, left string, right string, id int)
    words: DataFrame        # (word string, cnt bigint, ids array<int>): final ids per training word
    vocab_size: int
    rounds: int
    ranks: Broadcast | None = field(default=None, repr=False)


def train(words: DataFrame, vocab_size: int, min_frequency: int = 2, max_merges: int | None = None,
          top_pairs: int = 64) -> BpeModel:
    """Train on ``words(word, cnt)``; returns vocabulary, ordered merges and final ids."""
    if vocab_size > MAX_BROADCAST_VOCAB:
        raise ValueError(f"vocab_size {vocab_size} above the broadcast bound {MAX_BROADCAST_VOCAB}")
    spark = words.sparkSession
    got, state, rounds = train_tables(words, vocab_size, min_frequency, max_merges, top_pairs)
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(got.tokens)], "token string, id int")
    merges = spark.createDataFrame(got.merges, "rank int, left string, right string, id int")
    return BpeModel(vocab=vocab, merges=merges, words=state, vocab_size=len(got.tokens), rounds=rounds)


def ensure_specials(vocab: DataFrame) -> DataFrame:
    """Append special tokens missing from a loaded vocabulary, in list order.

    Only the (at most four) special tokens found in the vocabulary reach the driver.
    """
    spark = vocab.sparkSession
    present = {r["token"] for r in vocab.where(F.col("token").isin(*BL.SPECIAL_TOKENS))
               .select("token").collect()}
    missing = [t for t in BL.SPECIAL_TOKENS if t not in present]
    if not missing:
        return vocab.select("token", "id")
    base = vocab.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0]
    extra = spark.createDataFrame([(t, int(base) + i) for i, t in enumerate(missing)],
                                  "token string, id int")
    return vocab.select("token", "id").unionByName(extra)


# ---------------------------------------------------------------------------
# P8 / P9 / J4
# ---------------------------------------------------------------------------
def rank_table(model: BpeModel) -> Broadcast:
    """The model's merges as ids, (left, right) to (rank, id), sent to the workers once. Their
    number is checked against ``MAX_BROADCAST_VOCAB`` before any row is fetched."""
    if model.ranks is None:
        n = max(model.vocab.count(), model.merges.count())
        if n > MAX_BROADCAST_VOCAB:
            raise ValueError(f"{n} tokens or merges are above the broadcast bound {MAX_BROADCAST_VOCAB}")
        ids = {r["token"]: r["id"] for r in model.vocab.collect()}
        base = [ids[c] for c in BL.BYTE_CHARS]
        ranks = {(ids[r["left"]], ids[r["right"]]): (r["rank"], r["id"]) for r in model.merges.orderBy("rank").collect()}
        model.ranks = model.vocab.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, base, ranks))
    return model.ranks


_REMEMBERED: dict[str, dict[str, list[int]]] = {}


def _encode_batch(words: pa.ListArray, table: tuple[str, list[int], dict]) -> pa.ListArray:
    """Ids of each list of words: distinct words are encoded once, then gathered."""
    name, base, ranks = table
    seen = _REMEMBERED.get(name)
    if seen is None or len(seen) > REMEMBERED:
        if seen is None:
            _REMEMBERED.clear()  # one model a worker at a time
        seen = _REMEMBERED[name] = {}
    found = words.flatten().dictionary_encode()
    own = []
    for w in found.dictionary.to_pylist():
        got = seen.get(w)
        if got is None:
            got = seen[w] = merge_ids([base[b] for b in w.encode()], ranks)
        own.append(got)
    size = np.fromiter((len(o) for o in own), np.int64, len(own))
    start = np.concatenate([[0], np.cumsum(size)])
    ids = np.fromiter((i for o in own for i in o), np.int32, int(start[-1]))
    at = found.indices.to_numpy()
    sizes = size[at]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    places = np.repeat(start[at] - ends[:-1], sizes) + np.arange(ends[-1])
    lengths = np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy())])
    return pa.ListArray.from_arrays(pa.array(ends[lengths], pa.int32()), pa.array(ids[places], pa.int32()))


def encode_lists(words: pa.ListArray, table: tuple[str, list[int], dict]) -> pa.ListArray:
    """Ids of each list of words, a few rows at a time: the arrays of places in :func:`_encode_batch`
    take many times the bytes of the words."""
    some = [_encode_batch(words.slice(k, ROWS_AT_ONCE), table) for k in range(0, len(words), ROWS_AT_ONCE)]
    return pa.concat_arrays(some) if some else pa.array([], pa.list_(pa.int32()))


def token_ids(words: Column, model: BpeModel) -> Column:
    """Ids of a list of words (null: none), encoded where the row is."""
    table = rank_table(model)

    @F.arrow_udf("array<int>")
    def ids(lists: pa.Array) -> pa.Array:
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        return encode_lists(lists, table.value)

    return ids(words)


def encode(docs: DataFrame, model: BpeModel, key: str = "doc_id", text_col: str = "text",
           eos: bool = False) -> DataFrame:
    """``(key, ids)``; documents without any word have an empty id list."""
    ids = token_ids(T.words(F.coalesce(F.col(text_col), F.lit(""))), model)
    return docs.select(key, (BL.with_eos(ids) if eos else ids).alias("ids"))


def encode_pieces(docs: DataFrame, model: BpeModel, shard_col: str = "shard", ord_col: str = "ord",
                  text_col: str = "text", eos_id: int | None = BL.EOS_ID) -> DataFrame:
    """``(shard, ord, piece, ids)``, a row per ``PIECE_WORDS`` words plus one EOS row per
    document; no document is ever one array of ids, and nothing is shuffled."""
    n = F.ceil(F.size("words") / PIECE_WORDS).cast("int")
    own = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    last = F.lit(2 ** 31 - 1)
    # the EOS comes with the pieces: a union would read the documents, and judge them, once more
    every = own if eos_id is None else F.concat(own, F.array(last))
    parts = (docs.select(F.col(shard_col).alias("shard"), F.col(ord_col).alias("ord"), T.words(text_col).alias("words"))
             .select("shard", "ord", "words", F.explode(every).alias("piece")))
    some = F.when(F.col("piece") < last, F.slice("words", F.least(F.col("piece"), last / PIECE_WORDS - 1).cast("int") * PIECE_WORDS + 1,
                                                 F.lit(PIECE_WORDS)))
    t = parts.select("shard", "ord", "piece", some.alias("words"))
    t = t.select("shard", "ord", "piece", token_ids(F.col("words"), model).alias("ids"))
    if eos_id is None:
        return t
    return t.select("shard", "ord", "piece", F.when(F.col("piece") == last, F.array(F.lit(eos_id))).otherwise(F.col("ids")).alias("ids"))


def encode_with(docs: DataFrame, encode_fn, key: str = "doc_id", text_col: str = "text",
                eos_id: int | None = None) -> DataFrame:
    """A pluggable batch encoder ``encode_fn(list[str]) -> list[list[int]]`` run as an
    Arrow-batched pandas UDF (Series -> Series); EOS appended when given."""
    @F.pandas_udf("array<int>")
    def _enc(texts: pd.Series) -> pd.Series:
        return pd.Series(list(encode_fn(texts.tolist())))

    ids = _enc(F.col(text_col))
    return docs.select(key, BL.with_eos(ids, eos_id).alias("ids") if eos_id is not None else ids.alias("ids"))


def decode(doc_ids: DataFrame, vocab: DataFrame, key: str = "doc_id", ids_col: str = "ids",
           skip_special: bool = True) -> DataFrame:
    """Ids -> text. Tokens are looked up in the broadcast vocabulary, concatenated in order and
    mapped back from byte-level characters to UTF-8 (invalid sequences become U+FFFD)."""
    ex = doc_ids.select(key, F.posexplode(ids_col).alias("pos", "id"))
    v = vocab.select("token", "id")
    if skip_special:
        v = v.where(~F.col("token").isin(*BL.SPECIAL_TOKENS))
    j = ex.join(F.broadcast(v), "id")
    g = j.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))),
                                 lambda x: x["token"]), "").alias("bl"))
    out = doc_ids.select(key).join(g, key, "left")
    return out.select(key, BL.from_byte_level(F.coalesce("bl", F.lit(""))).alias("decoded"))


def roundtrip(lines: DataFrame, model: BpeModel, n_samples: int = 1000, ord_col: str = "ord",
              text_col: str = "text") -> DataFrame:
    """First ``n_samples`` non-empty lines in order; exact or equal after strip."""
    sample = materialize(lines.where(F.col(text_col) != "").orderBy(ord_col).limit(n_samples)
                         .select(ord_col, text_col), "roundtrip")  # read four times below
    enc = encode(sample, model, key=ord_col, text_col=text_col)
    dec = decode(enc, model.vocab, key=ord_col)
    j = sample.join(dec, ord_col)
    ok = (F.col("decoded") == F.col(text_col)) | (F.trim("decoded") == F.trim(text_col))
    return j.agg(F.count(F.lit(1)).cast("bigint").alias("roundtrip_checked"),
                 F.count(F.when(ok, F.lit(1))).cast("bigint").alias("roundtrip_exact")) \
        .withColumn("roundtrip_rate",
                    F.when(F.col("roundtrip_checked") > 0,
                           F.col("roundtrip_exact") / F.col("roundtrip_checked")))


def check_roundtrip(stats: DataFrame, min_rate: float = 0.95) -> dict:
    """fail the job when nothing was checked or the round-trip rate is below ``min_rate``."""
    r = stats.first().asDict()
    if not r["roundtrip_checked"]:
        raise RuntimeError("the sample for decoding is empty")
    if r["roundtrip_rate"] < min_rate:
        raise RuntimeError(f"share of exactly decoded lines {r['roundtrip_rate']:.3f} is below {min_rate} "
                           f"({r['roundtrip_exact']} of {r['roundtrip_checked']} lines)")
    return r
