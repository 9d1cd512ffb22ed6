"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; ``run`` writes each stage's result
into the shared folder and reads it again, so that a stage starts from a table and not from the
plans of those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup as lines
from tessera.llm import minhash, mixing, quality, sentencepiece_bpe
from tessera.llm.common import materialize, prepare, read
from tessera.llm.queries import piece_model

#: The encoding stage and its models have no SQL form.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line labels reject go."""
    return quality.judge(docs, read(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; n_chars follows the text."""
    out = lines.line_dedup(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    kept = minhash.near_dedup(docs, width=5).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    # one plan at every size: the texts are shuffled even where the ids could be broadcast
    return docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply_mix(docs, materialize(mixing.mix(docs), "pipeline-mix"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text by number and digest, and the digest of what they decode to."""
    return sentencepiece_bpe.digest(docs, piece_model()).drop("text")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("mixing", mix), ("sentencepiece", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs
