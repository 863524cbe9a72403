"""Which months have measurements on enough days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def month_audit(df: DataFrame, ts: str, p: float = 0.8, midnight_end: bool = False) -> DataFrame:
    """A row for each calendar month from the first to the last with data, months without any included.

    Columns: year, month, year_month, n_days_required, n_days_with_data, p,
    coverage, passes.  midnight_end: a month's last day counts only if it has a
    row at 00:00:00 (parity with records that were made that way).
    """
    if not 0 < p <= 1:
        raise ValueError("p must be in (0, 1]")
    rows = df.where(F.col(ts).isNotNull())
    month = F.trunc(F.to_date(ts), "month")
    counted = F.to_date(ts)
    if midnight_end:
        counted = F.when((F.to_date(ts) != F.last_day(F.to_date(ts))) | (F.col(ts) == F.to_date(ts).cast("timestamp_ntz")), counted)
    found = rows.groupBy(month.alias("_month")).agg(F.count_distinct(counted).alias("_days"))
    # The months with data are few, whatever the number of rows; the calendar is made from their range.
    span = found.agg(F.min("_month").alias("lo"), F.max("_month").alias("hi")).where(F.col("lo").isNotNull())
    months = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("_month"))
    days = F.day(F.last_day("_month"))
    have = F.coalesce("_days", F.lit(0))
    return months.join(found, "_month", "left").select(
        F.year("_month").alias("year"),
        F.month("_month").alias("month"),
        F.date_format("_month", "yyyy-MM").alias("year_month"),
        days.cast("int").alias("n_days_required"),
        have.cast("int").alias("n_days_with_data"),
        F.lit(float(p)).alias("p"),
        (have / days).alias("coverage"),
        (have / days >= F.lit(float(p))).alias("passes"),
    )


def keep_passing(df: DataFrame, ts: str, audit: DataFrame) -> DataFrame:
    """Rows in months that pass; rows without a time go.  audit is a month a row, so it is broadcast: 12 rows a year."""
    passing = F.broadcast(audit.where("passes").select(F.col("year").alias("_y"), F.col("month").alias("_m")))
    return df.join(passing, (F.year(ts) == F.col("_y")) & (F.month(ts) == F.col("_m")), "left_semi")
