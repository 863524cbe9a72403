"""Flag spans: runs of one flag in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.scalars import flag, micros, quoted


#: Spans are made within slices of time of this length first: a day.
SLICE_MICROS = 86_400_000_000


def flag_spans(df: DataFrame, ts: str, flag_col: str, gap: int = 3_600_000_000) -> DataFrame:
    """(flag, first, last, n): a gap of more than `gap` microseconds between rows of a flag starts a new span.

    Rows of a flag and slice of time are joined to pieces; only the pieces of a flag, few for each slice, are ordered together.
    """
    rows = df.select(F.col(ts).alias("_ts"), flag(quoted(flag_col)).alias("flag")).where("flag is not null and _ts is not null")
    rows = rows.withColumn("_slice", F.floor(micros(F.col("_ts")) / F.lit(SLICE_MICROS)))
    apart = lambda this, before: F.coalesce((micros(this) - micros(before) > gap).cast("int"), F.lit(1))
    w = Window.partitionBy("flag", "_slice").orderBy("_ts")
    numbered = rows.withColumn("_new", apart(F.col("_ts"), F.lag("_ts").over(w))).withColumn("_piece", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = numbered.groupBy("flag", "_slice", "_piece").agg(F.min("_ts").alias("_first"), F.max("_ts").alias("_last"), F.count("*").alias("_n"))
    w = Window.partitionBy("flag").orderBy("_first")
    joined = pieces.withColumn("_new", apart(F.col("_first"), F.lag("_last").over(w))).withColumn("_span", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return joined.groupBy("flag", "_span").agg(F.min("_first").alias("first"), F.max("_last").alias("last"), F.sum("_n").alias("n")).drop("_span")


def distinct_flags(df: DataFrame, ts: str, flag_col: str, year: int) -> DataFrame:
    """(flag) present in a year."""
    return df.where(F.year(ts) == year).select(flag(quoted(flag_col)).alias("flag")).where("flag is not null").distinct()
