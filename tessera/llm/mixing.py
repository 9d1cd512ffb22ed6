"""4. Mixing sources to target weights, by pivotal dependent rounding. DataFrame functions only.

A source's target divided by its size is the number of copies that each of its documents is due;
whole copies are taken as they are, the fraction left over is rounded by the pivotal method. Two
fractional documents meet and mass (probability times words) moves from one to the other until one
of them is at 0 or 1, in either direction with the probability that leaves both expectations as
they were. Words therefore add up to the target but for one last document of each source.

The meeting order is a reduction tree: documents are dealt into blocks of about ``fan`` by a hash
of their id, size and number among their like, a fold over a block's array leaves one residual
document, and the residuals of all blocks are the rows of the next level. A source that holds most
rows has most blocks; no task sees more than its blocks, and the number of levels is the logarithm
of the largest source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_name, materialize, prepare, uniform, word_count
from tessera.operators.order import with_ordinal

#: Fixed: weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
FAN = 32
#: Alike rows that one row stands for until they are written out.
RUN = 1024

_ITEM = "struct<h:bigint,id:string,size:bigint,whole:int,p:double>"
_DONE = "struct<id:string,size:bigint,copies:int>"
# One meeting of the residual a and the next document x. ``up`` is the mass that can move from x
# to a, ``down`` from a to x; a gains with probability down / (up + down).
_MEET = """
aggregate(items,
  named_struct('a', cast(null as {item}), 'done', cast(array() as array<{done}>)),
  (acc, x) -> if(acc.a is null, named_struct('a', x, 'done', acc.done),
    transform(transform(array(named_struct(
        'up', least((1 - acc.a.p) * acc.a.size, x.p * x.size),
        'down', least(acc.a.p * acc.a.size, (1 - x.p) * x.size),
        'u', pmod(xxhash64(acc.a.h, x.h, acc.a.id, x.id), 9007199254740992) / 9007199254740992D)),
      m -> named_struct(
        'gain', m.u * (m.up + m.down) < m.down,
        'ends', if(m.u * (m.up + m.down) < m.down,
                   (1 - acc.a.p) * acc.a.size <= x.p * x.size,
                   acc.a.p * acc.a.size <= (1 - x.p) * x.size),
        'pa', if(m.u * (m.up + m.down) < m.down, acc.a.p + m.up / acc.a.size, acc.a.p - m.down / acc.a.size),
        'px', if(m.u * (m.up + m.down) < m.down, x.p - m.up / x.size, x.p + m.down / x.size))),
      s -> if(s.ends,
        named_struct('a', named_struct('h', x.h, 'id', x.id, 'size', x.size, 'whole', x.whole,
                                       'p', least(1D, greatest(0D, s.px))),
                     'done', concat(acc.done, array(named_struct('id', acc.a.id, 'size', acc.a.size,
                                    'copies', acc.a.whole + if(s.gain, 1, 0))))),
        named_struct('a', named_struct('h', acc.a.h, 'id', acc.a.id, 'size', acc.a.size, 'whole', acc.a.whole,
                                       'p', least(1D, greatest(0D, s.pa))),
                     'done', concat(acc.done, array(named_struct('id', x.id, 'size', x.size,
                                    'copies', x.whole + if(s.gain, 0, 1)))))))[0]))
""".format(item=_ITEM, done=_DONE)


def source_targets(sized: DataFrame, ratio: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """One row per source: words, target. The shares are filled like water: with sources in the
    order of cap by weight, the level is the greatest of "what is left after the sources before
    this one are full, by the weight of the rest"."""
    sums = sized.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    by_name = Window.orderBy(F.col("_source").isNull(), "_source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sums.withColumn("_w", F.element_at(
        cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(cap) * F.col("_source_size"))
    everything = Window.partitionBy()
    filled = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").isNull(), "_source")
    left = (F.lit(ratio) * F.sum("_source_size").over(everything)
            - F.coalesce(F.sum("_cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    open_w = F.sum("_w").over(filled.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("_level", left / open_w)
    level = level.withColumn("_level", F.max("_level").over(everything))
    return level.select("_source", "_source_size",
                        F.least(F.col("_cap"), F.col("_level") * F.col("_w")).alias("_target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        ratio: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, fan: int = FAN,
        seed: int = 4) -> DataFrame:
    """(id, size, source_size, target, copies, taken) for each row of ``docs``.

    Sizes are words; null and empty texts have size 0 and are taken 0 times. Null sources are one
    source, the last. Null ids and repeated rows are documents of their own, rounded one by one
    (equal rows meet in one block, in any order: they are alike). Ties in the order cannot change
    totals. An empty table gives an empty table, a table without words targets of 0. Other
    columns are not read, so their names can't clash.
    """
    spark = docs.sparkSession
    prepare(spark)
    sized = materialize(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                                    word_count(F.col(text_col)).alias("_size")), "mix-sizes")
    id_type = sized.schema["_id"].dataType
    targets = materialize(source_targets(sized, ratio, cap, weights).withColumnRenamed("_source", "_name"),
                          "mix-targets")
    due = sized.join(targets, F.col("_source").eqNullSafe(F.col("_name")))
    due = due.withColumn("_due", F.when(F.col("_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0))
    due = due.withColumn("_whole", F.floor("_due").cast("int"))
    due = due.withColumn("_p", F.col("_due") - F.col("_whole"))
    keys = ["_name", "_source_size", "_target"]
    parts = [due.where(F.col("_p") <= 0).select("_id", "_size", *keys[1:], F.col("_whole").alias("_copies"))]
    # rows that agree in id and size are alike: they are counted, and each gets a number of its own, so
    # that rows of one id are dealt over all blocks; a large count is written out by many tasks
    alike = due.where(F.col("_p") > 0).groupBy(
        *keys, F.col("_id").cast("string").alias("_ident"), "_size", "_whole", "_p").agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("long")
    runs = alike.withColumn("_run", F.explode(F.sequence(zero, F.expr(f"(_n - 1) div {RUN}"))))
    runs = runs.repartition(F.xxhash64("_ident", "_size", "_run"))
    numbered = runs.withColumn("_k", F.explode(F.sequence(
        F.col("_run") * RUN, F.least(F.col("_n"), (F.col("_run") + 1) * RUN) - 1)))
    items = materialize(numbered.select(
        *keys, F.struct(F.xxhash64("_ident", "_size", "_k", F.lit(seed)).alias("h"), F.col("_ident").alias("id"),
                        F.col("_size").alias("size"), F.col("_whole").alias("whole"), F.col("_p").alias("p")).alias("x")),
        "mix-items")
    most = items.groupBy("_name").count().agg(F.max("count")).first()[0] or 0
    level = 0
    while most > 1:
        blocks = -(-most // fan)
        block = F.pmod(F.xxhash64(F.col("x.h"), F.lit(level), F.lit(seed)), F.lit(blocks))
        folded = (items.groupBy(*keys, block.alias("_block"))
                  .agg(F.array_sort(F.collect_list("x")).alias("items"))
                  .select(*keys, F.expr(_MEET).alias("r")).select(*keys, "r.a", "r.done"))
        folded = materialize(folded, f"mix-level{level}")
        parts.append(folded.select(*keys[1:], F.explode("done").alias("d"))
                     .select(F.col("d.id").cast(id_type).alias("_id"), F.col("d.size").alias("_size"), *keys[1:],
                             F.col("d.copies").alias("_copies")))
        items = folded.select(*keys, F.col("a").alias("x"))
        most, level = (blocks if blocks < most else 1), level + 1
    lucky = uniform(F.col("x.h"), F.lit(level), F.lit(seed)) < F.col("x.p")
    parts.append(items.select(F.col("x.id").cast(id_type).alias("_id"), F.col("x.size").alias("_size"), *keys[1:],
                              (F.col("x.whole") + lucky.cast("int")).alias("_copies")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"),
                      F.col("_source_size").cast("long").alias("source_size"),
                      F.col("_target").cast("double").alias("target"), F.col("_copies").alias("copies"),
                      (F.col("_copies") * F.col("_size")).cast("long").alias("taken"))


def apply_mix(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with each row as often as the mix takes it; all columns stay, whatever their names.

    Rows that share an id (null is one) and were given different numbers of copies are told apart by
    their size and dealt the copies of that size one by one, so the words taken are those that
    :func:`mix` decided. Among rows of one id and size it makes no difference which gets which."""
    spark = docs.sparkSession
    taken = [*docs.columns, *mixed.columns]
    mid, low, high, size, row, number, once, last = (free_name(n, taken) for n in (
        "mix_id", "mix_low", "mix_high", "mix_size", "mix_row", "mix_number", "mix_copy", "mix_last"))
    by_id = mixed.groupBy(F.col(id_col).alias(mid)).agg(F.min("copies").alias(low), F.max("copies").alias(high))
    by_id = materialize(by_id, "mix-copies")
    # one plan at every size: the texts are shuffled even where the decisions could be broadcast
    joined = docs.join(by_id.hint("merge"), docs[id_col].eqNullSafe(by_id[mid]))
    out = joined.where(F.col(low) == F.col(high)).select(*docs.columns, F.col(low).alias(number))
    unlike = by_id.where(F.col(low) < F.col(high)).select(mid)
    if not unlike.isEmpty():  # repeated ids only: nothing to deal otherwise
        rows = docs.join(unlike.hint("merge"), docs[id_col].eqNullSafe(unlike[mid]), "left_semi")
        rows = materialize(rows.select("*", word_count(F.col(text_col)).alias(size),
                                       F.monotonically_increasing_id().alias(row)), "mix-unlike")
        numbered = with_ordinal(rows, [row], number, partition_by=[id_col, size])
        # per id and size, the places of the rows that get each number of copies
        shares = mixed.join(unlike, mixed[id_col].eqNullSafe(unlike[mid]), "left_semi").groupBy(
            F.col(id_col).alias(mid), F.col("size").alias(low), F.col("copies").alias(high)).agg(F.count(F.lit(1)).alias(once))
        along = Window.partitionBy(mid, low).orderBy(high).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        shares = shares.withColumn(row, F.sum(once).over(along)).select(
            mid, low, high, (F.col(row) - F.col(once)).alias(once), F.col(row).alias(last))
        dealt = numbered.drop(row).join(shares, F.col(id_col).eqNullSafe(F.col(mid)) & (F.col(size) == F.col(low))
                                        & (F.col(number) > F.col(once)) & (F.col(number) <= F.col(last)))
        out = out.unionByName(dealt.select(*docs.columns, F.col(high).alias(number)))
    out = out.where(F.col(number) > 0)
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(number))).alias(once)).drop(once)
