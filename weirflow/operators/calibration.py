"""Walk-forward calibration of a forecast's bias, block by block.

A block's forecast is raised by the bias known at its start.  The bias after a
block is its old value plus the mean error that is left in the block, and the
old value cancels: it is the weighted mean of y - y_hat over the last block
before that has any weight.  So a window function does it, without a loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.metrics import usable, weighted_errors


def block_bias(df: DataFrame, block: int, window: Sequence[str] = ("window_id",)) -> DataFrame:
    """(window, block, own, bias): own error of each block (NULL without weight) and the bias it starts with."""
    if block < 1:
        raise ValueError("block must be at least 1")
    place = F.floor(F.col("step") / block).cast("int")
    w = F.when(F.col("valid") & F.col("y").isNotNull() & F.col("y_hat").isNotNull() & (F.col("w") > 0), F.col("w")).otherwise(0.0)
    e = F.coalesce(F.col("y") - F.col("y_hat"), F.lit(0.0))
    own = df.groupBy(*window, place.alias("block")).agg(F.when(F.sum(w) > 1e-12, F.sum(e * w) / F.sum(w)).alias("own"))
    past = Window.partitionBy(*window).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return own.withColumn("bias", F.coalesce(F.last("own", ignorenulls=True).over(past), F.lit(0.0)))


def calibrated(df: DataFrame, block: int, window: Sequence[str] = ("window_id",)) -> DataFrame:
    """df with block and y_cal; one pass over the rows of a window, which holds a forecast's steps."""
    if block < 1:
        raise ValueError("block must be at least 1")
    ok = F.col("valid") & F.col("y").isNotNull() & F.col("y_hat").isNotNull() & (F.col("w") > 0)
    w = F.when(ok, F.col("w")).otherwise(0.0)
    rows = df.withColumns({"block": F.floor(F.col("step") / block).cast("int"), "_w": w, "_e": F.coalesce(F.col("y") - F.col("y_hat"), F.lit(0.0)) * w})
    order = Window.partitionBy(*window).orderBy("block")
    same, past = order.rangeBetween(0, 0), order.rangeBetween(Window.unboundedPreceding, -1)
    own = F.when(F.sum("_w").over(same) > 1e-12, F.sum("_e").over(same) / F.sum("_w").over(same))
    bias = F.coalesce(F.last("_own", ignorenulls=True).over(past), F.lit(0.0))
    return rows.withColumn("_own", own).withColumn("y_cal", F.col("y_hat") + bias).drop("_w", "_e", "_own")


def calibration_report(df: DataFrame, block: int, window: Sequence[str] = ("window_id",)) -> DataFrame:
    """(kind, rmse, mae, bias, n) for kind raw and calibrated."""
    rows = calibrated(df, block, window)
    both = rows.select(F.explode(F.array(F.struct(F.lit("raw").alias("kind"), F.col("y_hat").alias("p")), F.struct(F.lit("calibrated").alias("kind"), F.col("y_cal").alias("p")))).alias("_k"), "y", "valid", "w")
    return weighted_errors(both.select("_k.kind", F.col("_k.p").alias("y_hat"), "y", "valid", "w"), ["kind"])


def first_blocks(df: DataFrame, block: int, limit: int = 70, window: Sequence[str] = ("window_id",)) -> DataFrame:
    """The first blocks, in order, with their starting bias and own error (a report of limited length)."""
    return block_bias(usable(df), block, window).orderBy(*window, "block").limit(limit)
