"""T4: keyed state with ``applyInPandasWithState`` (D3, T5 and T6 are in ``epochs``).

A key's rows of one trigger may arrive in several pandas chunks; every function reads them all,
orders them by the given sort key and scans once. State per key is bounded: at most ``rate``
timestamps. Within a key, order across triggers is
the source order (files in name order; watermark-bounded for timeouts).
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from tessera.functions.timecols import epoch_seconds
from tessera.operators.ratelimit import WINDOW_SECONDS


# ---------------------------------------------------------------------------
# T4: sliding-window admission per key
# ---------------------------------------------------------------------------
def _with_seconds(stream: DataFrame, ts_col: str) -> DataFrame:
    return stream.withColumn("_t", epoch_seconds(stream, ts_col))


def _type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def sliding(stream: DataFrame, key: str, ts_col: str, id_col: str, rate: int = 60) -> DataFrame:
    s = _with_seconds(stream, ts_col).select(key, "_t", id_col)

    def admit(k, pdfs, state):
        df = pd.concat(list(pdfs), ignore_index=True).sort_values(["_t", id_col], kind="mergesort")
        # times are in order, so only the last ``rate`` accepted ones matter
        win = deque(state.get[0] if state.exists else [], maxlen=rate)
        acc = []
        for t in df["_t"].to_numpy():
            ok = len(win) < rate or t - win[0] >= WINDOW_SECONDS
            if ok:
                win.append(float(t))
            acc.append(ok)
        state.update((list(win),))
        yield pd.DataFrame({id_col: df[id_col].to_numpy(), key: k[0], "accepted": acc})

    schema = f"{id_col} {_type(stream, id_col)}, {key} {_type(stream, key)}, accepted boolean"
    return s.groupBy(key).applyInPandasWithState(admit, schema, "win array<double>", "append",
                                                 GroupStateTimeout.NoTimeout)
