"""Errors of forecasts in long form: (window, step, y, y_hat, valid, w)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.scalars import finite


def usable(df: DataFrame, weighted: bool = False) -> DataFrame:
    """Rows with a valid, finite y and a finite y_hat (and a positive weight)."""
    kept = df.where(F.col("valid") & finite(F.col("y")).isNotNull() & finite(F.col("y_hat")).isNotNull())
    return kept.where(F.col("w") > 0) if weighted else kept


def errors(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, rmse, mae, n), each row alike; NULL without rows."""
    e = F.col("y") - F.col("y_hat")
    return usable(df).groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.count("*").alias("n"))


def weighted_errors(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, rmse, mae, bias, n); weights of 1e-12 in sum or less: NULL, n 0, bias 0."""
    e, w = F.col("y") - F.col("y_hat"), F.col("w")
    total = F.sum(w)
    enough = total > 1e-12
    mean: Column = lambda x: F.when(enough, F.sum(x * w) / total)
    return usable(df, True).groupBy(*by).agg(F.sqrt(mean(e * e)).alias("rmse"), mean(F.abs(e)).alias("mae"), F.coalesce(mean(e), F.lit(0.0)).alias("bias"), F.when(enough, F.count("*")).otherwise(0).alias("n"))


def per_step(df: DataFrame, weighted: bool = False) -> DataFrame:
    return (weighted_errors if weighted else errors)(df, ["step"])


def per_block(df: DataFrame, block: int, weighted: bool = False) -> DataFrame:
    """Errors pooled over blocks of that many steps (forecast days)."""
    return (weighted_errors if weighted else errors)(df.withColumn("block", F.floor(F.col("step") / block).cast("int")), ["block"])


def mean_baseline(train: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (long form) with y_hat, the mean of train's valid targets (one broadcast row); no such target is an error."""
    mean = train.where("valid").agg(F.avg("y").alias("_m"), F.count("y").alias("_n"))
    known = mean.select(F.when(F.col("_n") > 0, F.col("_m")).otherwise(F.raise_error(F.lit("no valid training target")).cast("double")).alias("y_hat"))
    return rows.crossJoin(F.broadcast(known))


def persistence_baseline(rows: DataFrame, require: bool = False) -> DataFrame:
    """rows (long form) with y_hat, the value at the end of the context, for all steps.

    With require it is an error if no row has both a valid target and an end value (a pass that counts them).
    """
    found = rows.withColumn("y_hat", F.col("end_value"))
    if not require:
        return found
    n = found.agg(F.count_if(F.col("valid") & finite(F.col("y")).isNotNull() & finite(F.col("y_hat")).isNotNull()).alias("_n"))
    checked = n.select(F.when(F.col("_n") > 0, F.lit(True)).otherwise(F.raise_error(F.lit("no valid target with an end value")).cast("boolean")).alias("_some"))
    return found.crossJoin(F.broadcast(checked)).where("_some").drop("_some")


def residuals(df: DataFrame) -> DataFrame:
    return df.withColumn("residual", F.col("y_hat") - F.col("y"))


def delta_target(df: DataFrame) -> DataFrame:
    """Targets relative to the end value, for models that predict the change."""
    return df.withColumn("delta", F.col("y") - F.col("end_value"))


def from_delta(df: DataFrame) -> DataFrame:
    return df.withColumn("y_hat", F.col("delta_hat") + F.col("end_value"))


def weighted_mse(df: DataFrame, y: str = "y", y_hat: str = "y_hat", by: Sequence[str] = ()) -> DataFrame:
    """(by, loss) over valid rows of positive weight; NULL without any."""
    e, w = F.col(y) - F.col(y_hat), F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0))
    kept = df.where(F.col("valid") & finite(F.col(y)).isNotNull() & finite(F.col(y_hat)).isNotNull())
    return kept.groupBy(*by).agg(F.when(F.sum(w) > 0, F.sum(w * e * e) / F.sum(w)).alias("loss"))


def tdalign(df: DataFrame, window: Sequence[str] = ("window_id",), loss: str = "mse", weighted: bool = True, need_previous: bool = True) -> DataFrame:
    """One row: level, difference, rho, total = rho * level + (1 - rho) * difference; NULL where no row counts.

    Rows count that are valid, have both values and, if weighted, a positive weight.  Differences are between steps, of the first step to end_value.  rho is the
    part of rows whose differences have not the same sign.  need_previous: only
    differences with both ends present count; otherwise one that lacks its
    previous value makes the difference term NULL.
    """
    if loss not in ("mse", "mae"):
        raise ValueError("loss must be mse or mae")
    w = Window.partitionBy(*window).orderBy("step")
    before = lambda c: F.when(F.col("step") == 0, F.col("end_value")).otherwise(F.lag(c).over(w))
    rows = df.withColumn("_dy", F.col("y") - before("y")).withColumn("_dh", F.col("y_hat") - before("y_hat"))
    rows = usable(rows, weighted)
    size = (lambda e: e * e) if loss == "mse" else F.abs
    weight = F.col("w") if weighted else F.lit(1.0)
    there = F.col("_dy").isNotNull() & F.col("_dh").isNotNull()
    share = lambda e, keep: F.sum(F.when(keep, size(e) * weight)) / F.greatest(F.sum(F.when(keep, weight)), F.lit(1e-12))
    differing = (F.signum("_dy") != F.signum("_dh")).cast("double")
    level = share(F.col("y_hat") - F.col("y"), F.lit(True))
    difference = share(F.col("_dh") - F.col("_dy"), there)
    if not need_previous:
        difference = F.when(F.count_if(~there) == 0, difference)
    found = rows.agg(level.alias("level"), difference.alias("difference"), F.avg(F.when(there, differing)).alias("rho"))
    return found.withColumn("total", F.col("rho") * F.col("level") + (1 - F.col("rho")) * F.col("difference"))


def distillation(student: DataFrame, teacher: DataFrame, alpha: float, beta: float = 0.0, residual: bool = False, teacher_is_delta: bool = False, on: Sequence[str] = ("window_id", "step")) -> DataFrame:
    """One row: supervised, distilled, end, loss = alpha * supervised + (1 - alpha) * distilled (+ beta * end).

    teacher's y_hat is taken to the student's form: changes from the end value
    if residual, else levels.  end is the error of the student's end_hat, if it
    has one and residual is set.
    """
    t = teacher.select(*on, F.col("y_hat").alias("_t"))
    both = student.join(t, list(on))
    end = F.col("end_value")
    level_t = F.col("_t") + end if teacher_is_delta else F.col("_t")
    target, guide = (F.col("y") - end, level_t - end) if residual else (F.col("y"), level_t)
    w = F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0))
    kept = F.col("valid") & target.isNotNull() & F.col("y_hat").isNotNull()
    loss = lambda goal, ok: F.sum(F.when(ok, w * (F.col("y_hat") - goal) * (F.col("y_hat") - goal))) / F.sum(F.when(ok & (w > 0), w))
    has_end = residual and "end_hat" in student.columns
    end_loss = F.avg((F.col("end_hat") - end) * (F.col("end_hat") - end)) if has_end else F.lit(0.0)
    found = both.agg(loss(target, kept).alias("supervised"), loss(guide, kept & guide.isNotNull()).alias("distilled"), end_loss.alias("end"))
    return found.withColumn("loss", alpha * F.col("supervised") + (1 - alpha) * F.col("distilled") + beta * F.col("end"))


def top_windows(df: DataFrame, k: int = 3, window: Sequence[str] = ("window_id",)) -> DataFrame:
    """The k windows with most usable steps: (window, n_valid); window is what tells windows apart."""
    return usable(df).groupBy(*window).agg(F.count("*").alias("n_valid")).orderBy(F.desc("n_valid"), *window).limit(k)


def by_target_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Predictions ordered by the time they are for, as they are stored for plots."""
    return df.orderBy(ts, "window_id", "step")
