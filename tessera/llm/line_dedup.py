"""1. Line dedup.

Lines are exploded, normalised and hashed; distinct documents are counted per hash; a line whose
hash is in ``min_docs`` documents or more stays only in the smallest document that holds it; what
is left is put together again in the order of the lines.

Only 16-byte keys are shuffled for the count (partial aggregation keeps a line that is in a third
of all documents to one row per map task). The keys over the threshold are written to the shared
folder: the join of lines with them then has an exchange on both sides, which lets Spark split a
hot key's partition. Texts move once, to meet their list of dropped keys.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, ascii_lower, ascii_trim, free_name, materialize, prepare

_TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line: str) -> str:
    return line.strip(SPACE).translate(_TABLE)


def _reassemble(text: pd.Series, dropped: pd.Series) -> pd.DataFrame:
    rows = []
    for t, gone in zip(text, dropped):
        lines = (t or "").split("\n")
        if gone is None or not len(gone):
            rows.append((len(lines), 0, t or ""))
            continue
        keys = {bytes(k) for k in gone}
        kept = [x for x in lines if hashlib.md5(line_key(x).encode()).digest() not in keys]
        rows.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """All columns of ``docs`` with the text replaced by its kept lines, plus ``n_lines`` (before)
    and ``n_dropped``.

    A null or empty text is one empty line, which is never dropped (its key is too short). Rows
    with equal ids are one document: they keep or lose the same lines. A null id counts as one
    document that comes after all others. An empty table gives an empty table. A very long text
    is one row, as in the input; its keys are counted apart from it. Input columns called
    ``n_lines`` or ``n_dropped`` are replaced.
    """
    spark = docs.sparkSession
    prepare(spark)
    keys = F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"),
                       lambda x: ascii_lower(ascii_trim(x)))
    lines = (docs.select(F.col(id_col).alias("_doc"), F.explode(keys).alias("_key"))
             .where(F.char_length("_key") >= min_chars)
             .select("_doc", F.unhex(F.md5("_key")).alias("_key")))
    first = F.min(F.struct(F.col("_doc").isNull().alias("no_id"), "_doc"))
    if min_docs == 2:  # two documents: the least and the greatest differ
        last = F.max(F.struct(F.col("_doc").isNull().alias("no_id"), "_doc"))
        counted = lines.groupBy("_key").agg(first.alias("_first"), last.alias("_last"))
        over = counted.where(~F.col("_first").eqNullSafe(F.col("_last")))
    else:
        counted = (lines.distinct().groupBy("_key")
                   .agg(first.alias("_first"), F.count(F.lit(1)).alias("_n")))
        over = counted.where(F.col("_n") >= min_docs)
    over = materialize(over.select(F.col("_key").alias("_over"), F.col("_first._doc").alias("_first")),
                       "line-keys")
    doc, dropped, parts = (free_name(x, docs.columns) for x in ("_gone_doc", "_gone", "_r"))
    gone = (lines.join(over, F.col("_key") == F.col("_over"))
            .where(~F.col("_doc").eqNullSafe(F.col("_first")))
            .groupBy(F.col("_doc").alias(doc))
            .agg(F.collect_set("_key").alias(dropped)))
    joined = docs.join(gone, docs[id_col].eqNullSafe(gone[doc]), "left")
    reassemble = F.pandas_udf(_reassemble, "n_lines long, n_dropped long, kept string")
    out = joined.withColumn(parts, reassemble(F.col(text_col), F.col(dropped)))
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    return out.select(*rest, F.col(parts)["kept"].alias(text_col), F.col(parts)["n_lines"].alias("n_lines"),
                      F.col(parts)["n_dropped"].alias("n_dropped"))
