"""Splits by time, scalers from the training split, and their application."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions.scalars import finite, quoted, restore, standardise


def split_label(ts: Column, train_end: str, val_end: str) -> Column:
    """train before train_end, val from there to before val_end, test after; NULL without a time."""
    if train_end >= val_end:
        raise ValueError("train_end must be before val_end")
    return F.when(ts < F.lit(train_end).cast("timestamp_ntz"), "train").when(ts < F.lit(val_end).cast("timestamp_ntz"), "val").when(ts.isNotNull(), "test")


def split(df: DataFrame, ts: str, train_end: str, val_end: str) -> DataFrame:
    return df.withColumn("split", split_label(F.col(ts), train_end, val_end))


def split_manifest(df: DataFrame, ts: str) -> DataFrame:
    return df.where(F.col("split").isNotNull()).groupBy("split").agg(F.count("*").alias("n_rows"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with scaler: map of column to (n, mean, std).  The population's std; under 1e-8 it counts as 1.

    A column without any finite value fails when the row is computed.
    """
    stats = []
    for c in columns:
        v = finite(quoted(c).cast("double"))
        sd = F.stddev_pop(v)
        checked = F.when(F.count(v) > 0, F.avg(v)).otherwise(F.raise_error(F.lit(f"no finite value in {c}")).cast("double"))
        stats += [F.lit(c), F.struct(F.count(v).alias("n"), checked.alias("mean"), F.when(sd < 1e-8, 1.0).otherwise(sd).alias("std"))]
    return df.agg(F.create_map(*stats).alias("scaler"))


def apply_scaler(df: DataFrame, scaler: DataFrame, columns: Sequence[str], suffix: str = "_z", inverse: bool = False) -> DataFrame:
    """df with standardised columns <column><suffix> (or, inverse, with <column> restored from <column><suffix>)."""
    both = df.crossJoin(F.broadcast(scaler.select(F.col("scaler").alias("_s"))))  # one row
    made: Mapping[str, Column] = {
        (c if inverse else c + suffix): (restore if inverse else standardise)(quoted(c + suffix) if inverse else finite(quoted(c).cast("double")), F.col("_s")[c]["mean"], F.col("_s")[c]["std"]) for c in columns
    }
    return both.withColumns(dict(made)).drop("_s")
