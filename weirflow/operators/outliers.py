"""Robust outlier labels: Hampel on the series, Tukey fences over all values and by month of the daily medians."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from weirflow.functions.scalars import clip, weight_of
from weirflow.operators.ordering import CHUNK_ROWS, in_chunks, numbered, percentiles
from weirflow.operators.rolling import moving_median

#: Standard deviations in one median absolute deviation of a normal distribution.
MAD_SCALE = 1.4826


def hampel(df: DataFrame, ts: str, tie: list[str], value: str, width: int = 49, n_sigma: float = 3.0, out: str = "spike", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """df with rolling_median, rolling_mad and the flag out; ts and tie must order the rows uniquely.

    Frames are centred and counted in rows; a frame of under max(3, width // 4)
    values has neither median nor deviation.  Chunks carry `width` rows of their
    neighbours, so a task holds chunk_rows + 2 * width rows, 4 * width at least.
    """
    after = (width - 1) // 2
    before, least = width - 1 - after, max(3, width // 4)
    rows = numbered(df, ts, tie)
    copied = in_chunks(rows.withColumn("_x", F.col(value).cast("double")), "_r", width, width, max(chunk_rows, 2 * width))
    schema = StructType([*(f for f in copied.schema.fields if f.name not in ("_x", "_home", "_chunk", "_r")), StructField("rolling_median", DoubleType()), StructField("rolling_mad", DoubleType()), StructField(out, BooleanType())])

    def label(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(table.column("_r").to_numpy(), kind="stable")))
        there = np.asarray(table.column("_x").is_valid())
        x = np.asarray(table.column("_x").fill_null(0.0))
        median, known = moving_median(x, there, before, after, least)
        mad, sure = moving_median(np.abs(x - median), there & known, before, after, least)
        spike = there & known & sure & (mad > 1e-12) & (np.abs(x - median) > n_sigma * MAD_SCALE * mad)
        kept = table.drop_columns(["_x", "_home", "_chunk", "_r"])
        for name, c in (("rolling_median", pa.array(median, mask=~known)), ("rolling_mad", pa.array(mad, mask=~sure)), (out, pa.array(spike))):
            kept = kept.append_column(name, c)
        return kept.filter(pc.equal(table.column("_home"), table.column("_chunk")))

    return copied.groupBy("_chunk").applyInArrow(label, schema)


def fences(df: DataFrame, value: str, by: list[str] | None = None, inner: float = 1.5, outer: float = 3.0) -> DataFrame:
    """n, inner_low, inner_high, outer_low, outer_high of each group.  Without a spread (IQR <= 0) the fences are min and max."""
    stats = percentiles(df, value, (0.25, 0.75), by or []).withColumnsRenamed({"q": "_q", "low": "_lo", "high": "_hi"})
    q1, q3 = F.col("_q")[0], F.col("_q")[1]

    def fence(low: bool, k: float) -> Column:
        reach = q1 - k * (q3 - q1) if low else q3 + k * (q3 - q1)
        return F.when(q3 - q1 > 0, reach).otherwise(F.col("_lo" if low else "_hi"))

    return stats.select(*(by or []), "n", fence(True, inner).alias("inner_low"), fence(False, inner).alias("inner_high"), fence(True, outer).alias("outer_low"), fence(False, outer).alias("outer_high"))


def outside(value: Column, low: Column, high: Column) -> Column:
    return F.coalesce((value < low) | (value > high), F.lit(False))


def global_tukey(df: DataFrame, value: str, inner: float = 1.5, outer: float = 3.0) -> DataFrame:
    """df with tukey_potential (outside the inner fences) and tukey_possible (outside the outer); one row of fences is broadcast."""
    f = F.broadcast(fences(df, value, None, inner, outer).select(*(F.col(c).alias("_" + c) for c in ("inner_low", "inner_high", "outer_low", "outer_high"))))
    both = df.crossJoin(f)
    v = F.col(value)
    return both.withColumn("tukey_potential", outside(v, F.col("_inner_low"), F.col("_inner_high"))).withColumn("tukey_possible", outside(v, F.col("_outer_low"), F.col("_outer_high"))).drop("_inner_low", "_inner_high", "_outer_low", "_outer_high")


def winsorised(df: DataFrame, value: str, k: float = 1.5, out: str = "winsorised") -> DataFrame:
    """df with values beyond the global fences set to them."""
    f = F.broadcast(fences(df, value, None, k, k).select(F.col("inner_low").alias("_lo"), F.col("inner_high").alias("_hi")))
    return df.crossJoin(f).withColumn(out, clip(F.col(value), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def daily_median(df: DataFrame, ts: str, value: str) -> DataFrame:
    """(day, daily_median); days without a value are left out."""
    return df.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.percentile(F.col(value), F.lit(0.5)).alias("daily_median"))


def month_tukey(daily: DataFrame, inner: float = 1.5, outer: float = 3.0, least: int = 10) -> DataFrame:
    """daily with potential and possible, by fences of the month of the year over all years; months of few days flag nothing."""
    months = daily.withColumn("_month", F.month("day"))
    f = F.broadcast(fences(months, "daily_median", ["_month"], inner, outer))  # 12 rows
    v, enough = F.col("daily_median"), F.col("n") >= least
    return months.join(f, "_month", "left").select("day", "daily_median", (enough & outside(v, F.col("inner_low"), F.col("inner_high"))).alias("potential"), (enough & outside(v, F.col("outer_low"), F.col("outer_high"))).alias("possible"))


def day_flag_to_rows(df: DataFrame, ts: str, daily: DataFrame, flag_col: str, out: str) -> DataFrame:
    """df with its day's flag; days that daily lacks are not flagged.  Spark broadcasts daily by its size."""
    days = daily.select(F.col("day").alias("_day"), F.col(flag_col).alias(out))
    return df.join(days, F.to_date(ts) == F.col("_day"), "left").withColumn(out, F.coalesce(out, F.lit(False))).drop("_day")


def labelled(df: DataFrame, ts: str, tie: list[str], value: str, width: int = 49, n_sigma: float = 3.0, winsor: bool = False) -> DataFrame:
    """All labels and weights: spike, tukey_potential, tukey_possible, monthly_potential, conservative, weight, weight_conservative.

    conservative: a spike on a day that the month's inner fences flag as well.
    """
    days = month_tukey(daily_median(df, ts, value))
    rows = global_tukey(hampel(df, ts, tie, value, width, n_sigma).drop("rolling_median", "rolling_mad"), value)
    rows = day_flag_to_rows(rows, ts, days, "potential", "monthly_potential")
    rows = rows.withColumn("conservative", F.col("spike") & F.col("monthly_potential")).withColumn("weight", weight_of(F.col("spike"))).withColumn("weight_conservative", weight_of(F.col("conservative")))
    return winsorised(rows, value) if winsor else rows


def label_summary(rows: DataFrame) -> DataFrame:
    """One row: rows, flags by kind, and the weights' sums."""
    flags = ("spike", "tukey_potential", "tukey_possible", "monthly_potential", "conservative")
    return rows.agg(F.count("*").alias("n_rows"), *(F.count_if(f).alias(f"n_{f}") for f in flags), F.sum("weight").alias("weight_sum"), F.sum("weight_conservative").alias("weight_conservative_sum"))
