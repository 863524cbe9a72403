"""The resampling panel over a stream: an extension, batch and stream give the same bins.

Watermarks stand on instants; times without a zone are taken as those of the session's.

Two stages, both kept in checkpointed state.  The first is an aggregation by bin: its
state are sums, or for medians the counts of a bin's distinct values, so it is
spread over bins and holds what is not yet closed.  The second sees one row for each closed
bin of a series and puts the empty bins between them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, TimestampNTZType

from weirflow.functions.scalars import DAY_MICROS, freq_micros, quoted
from weirflow.operators.resample import _aggregate

#: What transformWithState keeps its state in.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows that are handed on at once.
SEND = 1 << 14


def stateful(stream: DataFrame) -> DataFrame:
    """stream, its session set to the state store that keyed state and timers need."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return stream


def _interval(freq: str) -> str:
    return f"{freq_micros(freq)} microseconds"


def _binned(stream: DataFrame, ts: str, values: Sequence[str], freq: str, late: str, agg: str, keys: Sequence[str]) -> DataFrame:
    how = _aggregate(agg)
    shifted = stream.withColumn("_at", F.col(ts).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")).withWatermark("_at", late)
    return shifted.groupBy(*keys, F.window("_at", freq).alias("_w")).agg(*(how(quoted(v)).alias(v) for v in values), *(F.count(quoted(v)).alias(f"n_obs_{v}") for v in values))


def stream_panel(stream: DataFrame, ts: str, values: Sequence[str], freq: str = "30 minutes", late: str = "2 hours", agg: str = "mean", keys: Sequence[str] = ()) -> DataFrame:
    """Right-closed bins of a stream that have rows: keys, bin, mean or median and count of each value; rows later than `late` are dropped.

    A median's state holds the counts of a bin's distinct values.  freq must divide a day.
    """
    found = _binned(stream, ts, values, freq, late, agg, keys)
    return found.select(*keys, F.col("_w.end").alias("bin"), *(f"`{c}`" for c in found.columns if c not in (*keys, "_w")))


class Gaps(StatefulProcessor):
    """Puts the empty bins between a series' bins, which come closed and so in the order of time, batch by batch.

    With ahead a timer stands at the end of the next bin: when the watermark has
    passed it without a row, the empty bin is emitted at once.
    """

    def __init__(self, keys: Sequence[str], columns: Sequence[str], counts: Sequence[str], step: int, ahead: bool):
        self.keys, self.columns, self.counts, self.step, self.ahead = list(keys), list(columns), list(counts), step, ahead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("micros", LongType())]))

    def _frames(self, key: Any, at: np.ndarray, rows: pd.DataFrame | None) -> Iterator[pd.DataFrame]:
        """Frames of the bins at (microseconds), with the values of rows (by bin_micros) where there are some."""
        for k in range(0, len(at), SEND):
            out = pd.DataFrame({"bin_micros": at[k : k + SEND]})
            if rows is None:
                out = out.assign(**dict.fromkeys(self.columns, None))
            else:
                out = out.merge(rows[["bin_micros", *self.columns]], "left", "bin_micros")
            for c in self.counts:
                out[c] = out[c].fillna(0).astype("int64")
            for c in self.columns:
                if c not in self.counts:
                    out[c] = out[c].astype("float64")
            out["bin"] = out["bin_micros"].to_numpy().astype("datetime64[us]")
            for name, value in zip(self.keys, key, strict=False):
                out[name] = value
            yield out[[*self.keys, "bin", *self.columns]]

    def _remember(self, last: int) -> None:
        self.last.update((int(last),))
        if self.ahead:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.step) // 1000 + 1)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows))
        given = given.sort_values("bin_micros")  # a series' closed bins of one batch
        before = self.last.get()[0] if self.last.exists() else None
        given = given if before is None else given[given["bin_micros"] > before]
        if len(given):
            first = int(given["bin_micros"].iloc[0]) if before is None else before + self.step
            last = int(given["bin_micros"].iloc[-1])
            yield from self._frames(key, np.arange(first, last + 1, self.step), given)
            self._remember(last)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0]
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        at = np.arange(before + self.step, passed, self.step)
        if len(at):
            yield from self._frames(key, at, None)
            self._remember(int(at[-1]))

    def close(self) -> None:
        pass


def dense_panel(stream: DataFrame, ts: str, values: Sequence[str], freq: str = "30min", late: str = "2 hours", agg: str = "median", keys: Sequence[str] = (), ahead: bool = False) -> DataFrame:
    """Every bin from a series' first to its last closed one: keys, bin, values (NULL in empty bins) and n_obs_<value>; for append mode.

    It equals operators.resample on the closed bins.  Without keys all rows are one
    series, whose closed bins pass through one task, a row each.  With ahead the
    empty bins of a series that rests are emitted as the watermark passes them, else
    when its next bin closes.
    """
    step = freq_micros(freq)
    if DAY_MICROS % step:
        raise ValueError(f"{freq} must divide a day")
    found = _binned(stateful(stream), ts, values, _interval(freq), late, agg, keys)
    columns = [c for c in found.columns if c not in (*keys, "_w")]
    one = list(keys) or ["all_rows"]
    end = F.col("_w.end").cast("timestamp_ntz")
    rows = found.select(*(keys or [F.lit(0).alias("all_rows")]), F.window_time("_w").alias("bin_time"), F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), end).alias("bin_micros"), *(quoted(c) for c in columns))
    counts = [c for c in columns if c.startswith("n_obs_")]
    schema = StructType([*(f for f in stream.select(*keys).schema.fields), StructField("bin", TimestampNTZType()), *(rows.schema[c] for c in columns)])
    filled = rows.groupBy(*one).transformWithStateInPandas(Gaps(keys, columns, counts, step, ahead), StructType([StructField(f.name, f.dataType) for f in schema.fields]), "append", "EventTime" if ahead else "None")
    return filled
