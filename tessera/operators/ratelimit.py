"""T4/T5 (batch form): admission decisions for keyed request streams.

T5, fixed quota: the first ``max_req`` events of a key are accepted, the counter never resets.
The per-key row number is the bucketed ordinal (no per-key window).

T4, sliding window: an event is accepted when fewer than ``rate`` *accepted* events of its key lie
in the previous 60 s (``now - t < 60``); rejected events do not count. Each decision depends on
earlier decisions of the same key, so a key's events are scanned in order. A gap of 60 s or more
between consecutive events empties the window, so the scan restarts there: keys are cut into
independent segments at such gaps, and long segments further into chunks, which hand on the last
accepted times. What a chunk hands on is supposed first and put right in further passes.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.timecols import epoch_seconds
from tessera.operators.materialize import materialize
from tessera.operators.order import with_lag, with_ordinal, with_running_sums

WINDOW_SECONDS = 60.0
#: Events of a chunk of a busy segment.
CHUNK_ROWS = 1 << 16


def fixed_quota(events: DataFrame, key: str, order_cols: list[str], max_req: int = 60) -> DataFrame:
    """T5: adds ``accepted``."""
    n = with_ordinal(events, order_cols, "_k", partition_by=[key])
    return n.withColumn("accepted", F.col("_k") <= max_req).drop("_k")


def _segments(events: DataFrame, key: str, ts_sec: str, order_cols: list[str]) -> DataFrame:
    """Segment id per event: running count of >= 60 s gaps within the key (bucketed)."""
    lagged = with_lag(events, order_cols, {"_prev_ts": ts_sec}, partition_by=[key])
    gap = (F.col("_prev_ts").isNull() | (F.col(ts_sec) - F.col("_prev_ts") >= WINDOW_SECONDS)).cast("int")
    seg = with_running_sums(lagged.withColumn("_gap", gap), order_cols, {"segment": F.col("_gap")},
                            partition_by=[key])
    return seg.drop("_prev_ts", "_gap")


def _admit(times: list, recent: deque, rate: int) -> list[int]:
    """Places of the accepted events among sorted ``times``; ``recent`` holds the last ``rate`` accepted
    times before them and is carried on. Runs of refused events are jumped over."""
    out, i, n = [], 0, len(times)
    while i < n:
        if len(recent) == rate and times[i] - recent[0] < WINDOW_SECONDS:
            i = max(i + 1, bisect_left(times, recent[0] + WINDOW_SECONDS, i))
            continue
        recent.append(times[i])
        out.append(i)
        i += 1
    return out


def _scan(rate: int, decide: bool):
    """mapInArrow body over spans in order, each led by a row with ``_carry``, the accepted times
    before it. Gives the accepted rows (``decide``) or each span's last accepted times."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        recent, at = deque(maxlen=rate), None

        def last(where):
            return pa.RecordBatch.from_arrays([where, pa.array([list(recent)], pa.list_(pa.float64()))], names=["_at", "_recent"])

        for batch in batches:
            times = batch.column("_t").to_numpy(zero_copy_only=False)
            leads = np.flatnonzero(batch.column("_carry").is_valid().to_numpy(zero_copy_only=False)).tolist()
            accepted = np.zeros(len(times), bool)
            edges = [*leads, len(times)]
            for a, b, lead in [(0, edges[0], False), *((a, b, True) for a, b in zip(leads, edges[1:]))]:
                if lead:
                    if at is not None and not decide:
                        yield last(at)
                    recent = deque(batch.column("_carry")[a].as_py(), maxlen=rate)
                    at = batch.column("_at").slice(a, 1)
                    a += 1
                for i in _admit(times[a:b].tolist(), recent, rate):
                    accepted[a + i] = True
            if decide:
                rest = np.ones(len(times), bool)
                rest[leads] = False
                yield pa.RecordBatch.from_arrays([batch.column("_eid"), pa.array(accepted)], names=["_eid", "accepted"]).filter(pa.array(rest))
        if at is not None and not decide:
            yield last(at)
    return run


def _spans(events: DataFrame, leads: DataFrame) -> DataFrame:
    """Events and the leads of their spans, span by span in order of time."""
    both = events.select("_at", "_t", "_eid", F.lit(None).cast("array<double>").alias("_carry")).unionByName(
        leads.select("_at", F.lit(None).cast("double").alias("_t"), F.lit(None).cast(events.schema["_eid"].dataType).alias("_eid"),
                     "_carry"))
    return both.repartition("_at").sortWithinPartitions("_at", F.col("_t").asc_nulls_first(), "_eid")


def _settle(events: DataFrame, rate: int) -> DataFrame:
    """``(_seg, _width, _span, _carry)``: spans of ``_width`` chunks whose accepted times before them
    agree with what the span before leaves.

    All spans are scanned at once from supposed carries, first none. A segment in which some span's
    carry differs from what its predecessor left goes into another pass, from what was left and
    with spans of 16 times as many chunks, so the work of all passes is the events times the
    logarithm of the chunks; a segment whose decisions never fall into step ends as one span."""
    starts = materialize(events.groupBy("_seg", "_chunk").agg(F.min("_t").alias("_from")), "rate-chunks")
    none = F.array().cast("array<double>")
    pending, width, settled = starts.withColumn("_carry", none), 1, []
    while True:
        leads = pending.where(F.col("_chunk") % width == 0).withColumn("_span", F.expr(f"_chunk div {width}"))
        at = F.struct("_seg", "_span").alias("_at")
        rows = events.join(pending.select("_seg").distinct(), "_seg", "left_semi").select(
            "_seg", F.expr(f"_chunk div {width}").alias("_span"), "_t", "_eid").select(at, "_t", "_eid")
        stream = _spans(rows, leads.select(at, "_carry"))
        kind = stream.schema["_at"].dataType.simpleString()
        left = stream.mapInArrow(_scan(rate, False), f"_at {kind}, _recent array<double>").select(
            F.col("_at._seg").alias("_seg"), (F.col("_at._span") + 1).alias("_span"), "_recent")
        checked = leads.join(left, ["_seg", "_span"], "left").withColumn(
            "_left", F.filter(F.coalesce("_recent", none), lambda x: F.col("_from") - x < WINDOW_SECONDS)).drop("_recent")
        checked = materialize(checked, "rate-pass")
        wrong = checked.where(F.col("_left") != F.col("_carry")).select("_seg").distinct()
        settled.append(checked.join(wrong, "_seg", "left_anti").select("_seg", F.lit(width).alias("_width"), "_span", "_carry"))
        pending = checked.join(wrong, "_seg", "left_semi").select("_seg", "_chunk", "_from", F.col("_left").alias("_carry"))
        if not pending.take(1):
            return reduce(DataFrame.unionByName, settled)
        width *= 16


def sliding_window(events: DataFrame, key: str, ts_col: str, id_col: str, rate: int = 60,
                   chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """T4: adds ``accepted``. ``id_col`` is unique and breaks timestamp ties; events without a time
    are refused and count for nothing, and a null key is a key like others.

    Segments with fewer than ``rate`` events are accepted whole without leaving the JVM. Those with more
    than ``chunk_rows`` are cut into chunks of so many (numbered without a window over the segment), and
    chunks, not keys, are the unit of work: a key with a third of all events lies in many tasks."""
    e = events.withColumn("_t", epoch_seconds(events, ts_col))
    seg = _segments(e.where("_t is not null"), key, "_t", ["_t", id_col])
    seg = seg.select(F.struct(F.col(key), "segment").alias("_seg"), "_t", F.col(id_col).alias("_eid"))
    counts = seg.groupBy("_seg").agg(F.count(F.lit(1)).alias("_n"))
    seg = materialize(seg.join(counts, "_seg"), "rate-segments")
    easy = seg.where(F.col("_n") < rate).select("_eid", F.lit(True).alias("accepted"))
    at, whole = F.struct("_seg", "_span").alias("_at"), F.lit(0).cast("long").alias("_span")
    middle = seg.where((F.col("_n") >= rate) & (F.col("_n") <= chunk_rows)).select("_seg", whole, "_t", "_eid")
    rows = middle.select(at, "_t", "_eid")
    leads = middle.select(at, F.array().cast("array<double>").alias("_carry")).distinct()
    long = seg.where((F.col("_n") >= rate) & (F.col("_n") > chunk_rows))
    if long.take(1):
        hard = with_ordinal(long, ["_t", "_eid"], "_k", partition_by=["_seg"])
        hard = materialize(hard.select("_seg", F.expr(f"(_k - 1) div {chunk_rows}").alias("_chunk"), "_t", "_eid"), "rate-hard")
        cut = materialize(_settle(hard, rate), "rate-settled")
        spans = hard.join(cut.select("_seg", "_width").distinct(), "_seg").withColumn("_span", F.expr("_chunk div _width"))
        rows = rows.unionByName(spans.select(at, "_t", "_eid"))
        leads = leads.unionByName(cut.select(at, "_carry"))
    dec = _spans(rows, leads).mapInArrow(_scan(rate, True), f"_eid {events.schema[id_col].dataType.simpleString()}, accepted boolean")
    late = e.where("_t is null").select(F.col(id_col).alias("_eid"), F.lit(False).alias("accepted"))
    return events.join(easy.unionByName(dec).unionByName(late).withColumnRenamed("_eid", id_col), id_col)


def sliding_window_reference(ts: list[float], rate: int = 60) -> list[bool]:
    """Plain-Python statement of T4 for one key, for tests."""
    kept: list[float] = []
    out = []
    for t in ts:
        recent = [x for x in kept if t - x < WINDOW_SECONDS]
        if len(recent) < rate:
            kept = recent + [t]
            out.append(True)
        else:
            kept = recent
            out.append(False)
    return out
