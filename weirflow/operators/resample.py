"""Series to a regular grid: right-closed bins with right labels, anchored at midnight of the first day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.scalars import DAY_MICROS, freq_micros, from_micros, micros, quoted, weight
from weirflow.operators.ordering import join_on


#: Grid points that are made at once.
GRID_BLOCK = 4096


def _aggregate(agg: str):
    if agg == "median":
        return lambda c: F.percentile(c, F.lit(0.5))
    if agg == "mean":
        return F.avg
    raise ValueError(f"agg must be median or mean, not {agg!r}")


def bin_end(ts: Column, step: int, origin: Column) -> Column:
    """Microseconds of the least grid point not before ts."""
    us = micros(ts)
    return origin + F.ceil((us - origin) / F.lit(step)).cast("long") * F.lit(step)


def resample(df: DataFrame, ts: str, values: Sequence[str], freq: str, agg: str = "median", counts: bool = True, out: str = "bin", keys: Sequence[str] = ()) -> DataFrame:
    """One row for every grid point from the first bin to the last, of each key.

    Values are aggregated without NULLs (NULL in empty bins); with counts,
    n_obs_<value> is the number of values.  All of it is one aggregation; the
    grid is generated from the bins' range and joined to it.  A NULL key is a key.
    """
    step, how = freq_micros(freq), _aggregate(agg)
    rows = df.where(F.col(ts).isNotNull())
    if DAY_MICROS % step == 0:  # then any midnight is on the grid, and no pass over the rows is needed to find the first
        placed = rows.withColumn("_bin", bin_end(F.col(ts), step, F.lit(0).cast("long")))
    else:
        first = rows.groupBy(*keys).agg(micros(F.min(F.date_trunc("day", F.col(ts)).cast("timestamp_ntz"))).alias("_origin"))
        placed = join_on(rows, first, keys).withColumn("_bin", bin_end(F.col(ts), step, F.col("_origin"))).drop("_origin")
    columns = [how(quoted(v)).alias(v) for v in values] + [F.count(quoted(v)).alias(f"n_obs_{v}") for v in values if counts]
    binned = placed.groupBy(*keys, "_bin").agg(*columns)
    # The grid comes in blocks, so that no row holds all of it.
    span = F.lit(step * GRID_BLOCK).cast("long")
    ends = binned.groupBy(*keys).agg(F.min("_bin").alias("_lo"), F.max("_bin").alias("_hi")).where("_lo is not null")
    blocks = ends.select(*keys, "_hi", F.explode(F.sequence("_lo", "_hi", span)).alias("_at"))
    spine = blocks.select(*keys, F.explode(F.sequence("_at", F.least(F.col("_at") + span - F.lit(step), F.col("_hi")), F.lit(step).cast("long"))).alias("_bin"))
    full = join_on(spine, binned, [*keys, "_bin"], "left")
    if counts:
        full = full.fillna(0, [f"n_obs_{v}" for v in values])
    return full.withColumn(out, from_micros(F.col("_bin"))).select(*keys, out, *(F.col(f"`{c}`") for c in binned.columns if c not in (*keys, "_bin")))


def resample_weights(df: DataFrame, ts: str, weights: Sequence[str], freq: str, agg: str = "mean", out: str = "bin") -> DataFrame:
    """Weights on the grid, as <weight>_resampled; NULL in empty bins."""
    clean = df.withColumns({w: weight(quoted(w).try_cast("double")) for w in weights})
    found = resample(clean, ts, weights, freq, agg, counts=False, out=out)
    return found.withColumnsRenamed({w: f"{w}_resampled" for w in weights})


def with_weights(panel: DataFrame, weights: DataFrame, on: str = "bin") -> DataFrame:
    """panel with the weights of its bins; NULL where there is none."""
    return panel.join(weights, on, "left")
