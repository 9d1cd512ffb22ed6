"""Run logs and step metrics.

``run_metrics(run, step, ts, loss, ...)``. Per-run orderings use the bucketed primitives of
``order`` (a run with a third of all rows is still spread over many tasks); the only per-run
window is the keep-last-N filter, which Spark plans with a per-partition group limit before the
shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.timecols import epoch_micros
from tessera.operators.filters import finite
from tessera.operators.order import with_lag, with_ordinal, with_running_extreme

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------
STEP_PATTERN = r"step[= ]+([0-9]+)"
# The reference's loss pattern is unanchored (it also matches "val_loss="); ours requires a word
# boundary by default. Pass anchored=False for the reference behaviour.
LOSS_PATTERN = r"loss[= ]+([0-9.eE+-]+)"
# Names of step checkpoints.
ARTIFACT_PATTERN = r"step_([0-9]+)\.pt"


def last_match(line: Column, pattern: str) -> Column:
    """Last capture of ``pattern`` in the line (null when absent)."""
    allm = F.regexp_extract_all(line, F.lit(pattern), 1)
    return F.when(F.size(allm) > 0, F.element_at(allm, -1))


def parse_log_line(line: Column, anchored: bool = True) -> tuple[Column, Column]:
    """Last ``step`` integer and last ``loss`` number of a log line."""
    lp = (r"\b" if anchored else "") + LOSS_PATTERN
    step = last_match(line, STEP_PATTERN).cast("bigint")
    loss = last_match(line, lp).cast("double")
    return step, loss


def with_step(df: DataFrame, run: str, order_cols: list[str], name: str = "step") -> DataFrame:
    """Number rows per run in order (bucketed; 1-based)."""
    return with_ordinal(df, order_cols, name, partition_by=[run])


def best_step(metrics: DataFrame, run: str = "run", step: str = "step", loss: str = "val_loss") -> DataFrame:
    """Per run, the step with the lowest finite loss; the earliest step wins ties (strict <)."""
    m = metrics.where(finite(loss))
    s = F.min_by(F.struct(F.col(step).alias("step"), F.col(loss).alias("loss")),
                 F.struct(F.col(loss), F.col(step)))
    return m.groupBy(run).agg(s.alias("b")).select(run, F.col("b.step").alias("best_step"),
                                                   F.col("b.loss").alias("best_loss"))


def running_best(metrics: DataFrame, run: str = "run", step: str = "step", loss: str = "val_loss") -> DataFrame:
    """Best loss so far at every step."""
    return with_running_extreme(metrics.where(finite(loss)), [step], "best_so_far", F.col(loss),
                                "min", partition_by=[run])


def keep_last(artifacts: DataFrame, n: int, run: str = "run", step: str = "step") -> DataFrame:
    """Artefacts to keep — the last ``n`` by step per run (``n <= 0`` keeps none)."""
    if n <= 0:
        return artifacts.limit(0)
    w = Window.partitionBy(run).orderBy(F.desc(step))
    return artifacts.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n).drop("_rk")


def listed_artifacts(spark: SparkSession, path_glob: str, pattern: str = ARTIFACT_PATTERN) -> DataFrame:
    """(folder, name, step, bytes) of the stored artefacts under a glob of their part files. Only the
    listing is read, no content. An artefact is a file or a folder of part files whose name matches the
    whole pattern (its first group is the step); everything else is ignored."""
    whole = "^(.*?)([^/=]*)(?:/part-[^/]*)?$"
    files = spark.read.format("binaryFile").load(path_glob).select(
        F.regexp_extract("path", whole, 1).alias("folder"), F.regexp_extract("path", whole, 2).alias("name"), "length")
    named = files.withColumn("step", F.regexp_extract("name", f"^(?:{pattern})$", 1).try_cast("bigint"))
    return (named.where("step is not null").groupBy("folder", "name", "step")
            .agg(F.sum("length").cast("bigint").alias("bytes")))


def prune_plan(artifacts: DataFrame, n: int, run: str = "folder", step: str = "step") -> DataFrame:
    """W15, first phase: every artefact with ``keep`` (the last ``n`` of its run; none for ``n <= 0``)."""
    w = Window.partitionBy(run).orderBy(F.desc(step))
    keep = (F.row_number().over(w) <= n) if n > 0 else F.lit(False)
    return artifacts.withColumn("keep", keep)


def apply_prune(plan: DataFrame) -> int:
    """W15, second phase: delete what a stored plan doesn't keep, through the file system that holds it.
    An artefact that is gone already is passed over, so the phase can run again. Returns the deletions.
    The plan must not be computed from the listing while that changes: store it first."""
    spark = plan.sparkSession
    conf, jvm, done = spark._jsc.hadoopConfiguration(), spark._jvm, 0
    for row in plan.where("not keep").select(F.concat("folder", "name").alias("path")).toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(row["path"])
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def latest_status(metrics: DataFrame, run: str = "run", step: str = "step", loss: str = "loss",
                  order: str | None = None) -> DataFrame:
    """The last step and the last loss that each run logged, apart, by ``order`` (the place in the
    log; the step when none is given). A run that resumed from an earlier step shows its newest line.
    Null values are passed over. Partial aggregates."""
    at = F.col(order or step)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), at))
    return metrics.groupBy(run).agg(last(step).alias("last_step"), last(loss).alias("last_loss"))


def throughput(metrics: DataFrame, tokens_per_step: int, run: str = "run", step: str = "step",
               ts: str = "ts") -> DataFrame:
    """``tokens_per_step / max(dt, 1e-9)`` with ``dt`` the time since the previous step."""
    m = metrics.withColumn("_us", epoch_micros(metrics, ts))
    lagged = with_lag(m, [step], {"_prev_us": "_us"}, partition_by=[run])
    secs = (F.col("_us") - F.col("_prev_us")) / F.lit(1e6)
    return lagged.withColumn("tok_s", F.when(F.col("_prev_us").isNotNull(),
                                             F.lit(float(tokens_per_step)) / F.greatest(secs, F.lit(1e-9)))) \
        .drop("_prev_us", "_us")


def tokens_per_step(batch: int, accum: int, context: int) -> int:
    return batch * accum * context


def step_means(micro: DataFrame, accum: int, run: str = "run", micro_col: str = "micro",
               loss: str = "loss") -> DataFrame:
    """Mean micro-batch loss per optimizer step (``step = (micro-1) div accum + 1``)."""
    st = F.floor((F.col(micro_col) - 1) / accum).cast("bigint") + 1
    return micro.groupBy(run, st.alias("step")).agg(F.avg(loss).alias("loss"),
                                                   F.count(F.lit(1)).cast("bigint").alias("micro_batches"))


def every_nth(metrics: DataFrame, n: int, step: str = "step") -> DataFrame:
    """Reporting rows (``step % n == 0``) — the log/eval cadence of the training loop."""
    return metrics.where(F.pmod(F.col(step), F.lit(n)) == 0)


def trajectory(metrics: DataFrame, run: str = "run", step: str = "step", loss: str = "val_loss") -> DataFrame:
    """Per run and step, the value and its change since the previous reported step."""
    lagged = with_lag(metrics.select(run, step, loss), [step], {"_prev": loss}, partition_by=[run])
    return lagged.withColumn("delta", F.col(loss) - F.col("_prev")).drop("_prev")
