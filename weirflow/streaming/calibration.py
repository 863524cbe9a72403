"""Walk-forward calibration over a stream: an extension, batch and stream give the same rows.

A window's rows come in any order within the watermark's delay.  A block's starting
bias is known when the watermark has reached its first row: then all rows of the
blocks before are in.  Until then its rows wait in keyed state; after that further
rows of the block go out as they come.  State is a window's sums of the blocks that
are not yet closed, its waiting rows and its bias.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType, TimestampNTZType

from weirflow.functions.scalars import finite
from weirflow.streaming.panel import stateful

_D, _L, _I = DoubleType(), LongType(), IntegerType()
_FIELDS = ["step", "us", "y", "y_hat", "valid", "w"]


class Calibration(StatefulProcessor):
    """State of a window: sums (error, weight) and first time of each block; waiting rows; the open block and its bias."""

    def __init__(self, keys: Sequence[str], block: int):
        self.keys, self.block = list(keys), block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        place = StructType([StructField("block", _I)])
        self.sums = handle.getMapState("sums", place, StructType([StructField("e", _D), StructField("w", _D), StructField("us", _L)]))
        # An entry holds the rows of one block that came together.
        self.waiting = handle.getMapState("waiting", StructType([StructField("block", _I), StructField("n", _L)]), StructType([StructField("rows", BinaryType())]))
        self.open = handle.getValueState("open", StructType([StructField("block", _I), StructField("bias", _D), StructField("n", _L)]))

    def _out(self, key: Any, rows: list[tuple], block: int, bias: float) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=_FIELDS).astype({"step": "int32", "y": "float64", "y_hat": "float64", "w": "float64"})
        out["ts"] = out.pop("us").to_numpy().astype("datetime64[us]")
        out["block"], out["y_cal"] = block, out["y_hat"] + bias
        for name, value in zip(self.keys, key, strict=True):
            out[name] = value
        return out[[*self.keys, "step", "ts", "y", "y_hat", "valid", "w", "block", "y_cal"]].astype({"block": "int32"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        opened, bias, n = self.open.get() if self.open.exists() else (-1, 0.0, 0)
        for frame in rows:
            frame = frame.astype(object).where(frame.notna(), None)
            frame["block"] = frame["step"].astype(int) // self.block
            for block, own in frame.groupby("block"):
                block = int(block)
                if block < opened:  # its blocks are closed
                    continue
                found = [tuple(r) for r in own[_FIELDS].itertuples(index=False, name=None)]
                e, w, us = self.sums.getValue((block,)) if self.sums.containsKey((block,)) else (0.0, 0.0, None)
                for _, at, y, p, ok, weight in found:
                    if ok and y is not None and p is not None and weight is not None and weight > 0:
                        e, w = e + (y - p) * weight, w + weight
                    us = at if us is None else min(us, at)
                self.sums.updateValue((block,), (float(e), float(w), int(us)))
                if block == opened:
                    yield self._out(key, found, block, bias)
                elif block > opened:
                    self.waiting.updateValue((block, n), (pickle.dumps(found),))
                    n += 1
                    self.handle.registerTimer(-(-int(us) // 1000))
        self.open.update((int(opened), float(bias), int(n)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        opened, bias, n = self.open.get()
        known = sorted((k[0], v) for k, v in self.sums.iterator())
        for block, (_, _, us) in known:
            if block <= opened or us > passed:
                continue
            # All blocks before this one are complete: the last of them with any weight gives the bias.
            for old, (e, w, _) in known:
                if old < block:
                    if w > 1e-12 and self.sums.containsKey((old,)):
                        bias = e / w
                    if self.sums.containsKey((old,)):
                        self.sums.removeKey((old,))
            opened = block
            ready = sorted(k for k in self.waiting.keys() if k[0] == block)  # noqa: SIM118 - a state, not a dict
            rows = [r for k in ready for r in pickle.loads(self.waiting.getValue(k)[0])]
            for k in ready:
                self.waiting.removeKey(k)
            self.open.update((int(opened), float(bias), int(n)))
            if rows:
                yield self._out(key, rows, block, bias)

    def close(self) -> None:
        pass


def calibrated_stream(stream: DataFrame, block: int, window: Sequence[str] = ("window_id",), ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """window, step, ts, y, y_hat, valid, w, block and y_cal of a stream of long rows (window, step, ts, y, y_hat, valid, w); for append mode.

    Rows go out when their block's bias is known; those of blocks whose first row the
    watermark has not reached wait.  Rows later than the watermark are dropped.
    Steps must follow ts within a window.
    """
    if block < 1:
        raise ValueError("block must be at least 1")
    at = F.col(ts).cast("timestamp_ntz")
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), at)
    rows = stateful(stream).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).select(*window, F.col("step").cast("int").alias("step"), F.col(ts).alias("row_time"), us.alias("us"), finite(F.col("y").cast("double")).alias("y"), finite(F.col("y_hat").cast("double")).alias("y_hat"), "valid", F.col("w").cast("double").alias("w"))
    own = [StructField(f.name, f.dataType) for f in stream.select(*window).schema.fields]
    kinds = {"step": _I, "ts": TimestampNTZType(), "y": _D, "y_hat": _D, "valid": BooleanType(), "w": _D, "block": _I, "y_cal": _D}
    schema = StructType([*own, *(StructField(name, kind) for name, kind in kinds.items())])
    return rows.groupBy(*window).transformWithStateInPandas(Calibration(window, block), schema, "append", "EventTime")
