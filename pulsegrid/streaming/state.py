"""Per-entity state on streamed windows.

State is one small row per entity. An entity's windows of one micro-batch arrive
together and are put in time order before they meet the state.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pulsegrid.session import use_rocksdb

def _in_order(batches: Iterator[pd.DataFrame], ts: str) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(ts, ignore_index=True)


class _Fill(StatefulProcessor):
    """Carries the last non-null value of each column."""

    def __init__(self, cols: list[str], ts: str):
        self.cols, self.ts = cols, ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = T.StructType([T.StructField(c, T.DoubleType(), True) for c in self.cols])
        self.last = handle.getValueState("last", schema)

    def handleInputRows(self, key, rows, timerValues):
        pdf = _in_order(rows, self.ts)
        known = dict(zip(self.cols, self.last.get())) if self.last.exists() else {}
        for c in self.cols:
            pdf[c] = pdf[c].astype("float64").ffill()
            if known.get(c) is not None:
                pdf[c] = pdf[c].fillna(known[c])
        final = [None if pd.isna(v) else float(v) for v in pdf[self.cols].iloc[-1]]
        self.last.update(tuple(final))
        for c in self.cols:
            pdf[c] = pdf[c].astype(object).where(pdf[c].notna(), None)
        yield pdf

    def close(self) -> None:
        pass


class _Position(StatefulProcessor):
    """Numbers an entity's windows and measures hours since its first one."""

    def __init__(self, ts: str):
        self.ts = ts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "first timestamp, n bigint")

    def handleInputRows(self, key, rows, timerValues):
        pdf = _in_order(rows, self.ts)
        first, n = pdf[self.ts].iloc[0], 0
        if self.seen.exists():
            first, n = self.seen.get()
            first = pd.Timestamp(first)
        pdf["window_idx"] = range(n, n + len(pdf))
        pdf["hours_in_icu"] = (pdf[self.ts] - first).dt.total_seconds() / 3600.0
        self.seen.update((pd.Timestamp(first).to_pydatetime(), n + len(pdf)))
        yield pdf

    def close(self) -> None:
        pass


def stream_forward_fill(stream: DataFrame, key: str, cols: list[str],
                        ts: str = "window_start_time") -> DataFrame:
    """Forward fill across micro-batches, per entity."""
    use_rocksdb(stream.sparkSession)
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Fill(cols, ts), outputStructType=stream.schema,
        outputMode="Append", timeMode="None",
    )


def stream_positions(stream: DataFrame, key: str, ts: str = "window_start_time") -> DataFrame:
    """Add window_idx and hours_in_icu that keep counting across micro-batches."""
    use_rocksdb(stream.sparkSession)
    schema = T.StructType(
        stream.schema.fields
        + [T.StructField("window_idx", T.LongType(), True),
           T.StructField("hours_in_icu", T.DoubleType(), True)]
    )
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Position(ts), outputStructType=schema,
        outputMode="Append", timeMode="None",
    )
