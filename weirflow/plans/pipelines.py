"""The ways from logs to labels, from a panel to windows, and from windows to reports.

Each stage is lazy; ``store`` writes a stage where later runs want to read it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.scalars import freq_micros, hampel_rows, resolve_freq
from weirflow.operators import calendar, calibration, metrics, outliers, resample, splits, stats, training, windows
from weirflow.operators.models import ForecastConfig, predict
from weirflow.sources.sensor_logs import FEATURES, TARGET, TIME, masked_series, trimmed_target, weight_table, write


@dataclass(frozen=True)
class GroundTruth:
    """Labels of the target in months that are covered."""

    p: float = 0.8
    freq: str | None = None
    hampel_hours: float = 24.0
    n_sigma: float = 3.0
    winsor: bool = False
    midnight_end: bool = False


@dataclass(frozen=True)
class TrainingSet:
    freq: str | None = None
    agg: str = "median"
    p: float | None = None
    train_end: str = "2019-01-01"
    val_end: str = "2021-01-01"
    window: windows.WindowSettings = field(default_factory=windows.WindowSettings)


def ground_truth(spark: SparkSession, glob: str, s: GroundTruth = GroundTruth(), target: str = TARGET) -> dict[str, DataFrame]:
    """audit, series (in passing months), labels, daily and summary."""
    series = trimmed_target(spark, glob, target)
    audit = calendar.month_audit(series, TIME, s.p, s.midnight_end)
    kept = calendar.keep_passing(series, TIME, audit).withColumnRenamed(target, "value")
    labels = outliers.labelled(kept, TIME, [], "value", hampel_rows(s.hampel_hours, resolve_freq(s.freq)), s.n_sigma, s.winsor)
    daily = outliers.month_tukey(outliers.daily_median(kept, TIME, "value"))
    return {"audit": audit, "series": kept, "labels": labels, "daily": daily, "summary": outliers.label_summary(labels)}


def panel(spark: SparkSession, glob: str, s: TrainingSet = TrainingSet(), features: Sequence[str] = FEATURES, target: str = TARGET, weights: str | None = None) -> DataFrame:
    """The resampled panel; months are restricted with s.p, weights joined if a table of them is given."""
    freq = resolve_freq(s.freq)
    rows = masked_series(spark, glob, (*features, target))
    if s.p is not None:
        rows = calendar.keep_passing(rows, TIME, calendar.month_audit(trimmed_target(spark, glob, target), TIME, s.p))
    found = resample.resample(rows, TIME, [*features, target], freq, s.agg, out=TIME)
    if weights is None:
        return found
    w = weight_table(spark, weights)
    return resample.with_weights(found, resample.resample_weights(w, TIME, [c for c in w.columns if c != TIME], freq, out=TIME), TIME)


def training_set(rows: DataFrame, s: TrainingSet = TrainingSet(), features: Sequence[str] = FEATURES, target: str = TARGET, ts: str = TIME) -> dict[str, DataFrame]:
    """split (with <column>_z), scaler, manifest and windows; each split is windowed by itself."""
    parted = splits.split(rows, ts, s.train_end, s.val_end).where("split is not null")
    scaler = splits.fit_scaler(parted.where("split = 'train'"), [*features, target])
    scaled = splits.apply_scaler(parted, scaler, [*features, target])
    found = windows.sliding(scaled, ts, [f"{c}_z" for c in features], f"{target}_z", s.window)
    return {"split": scaled, "scaler": scaler, "manifest": splits.split_manifest(parted, ts), "windows": found}


def baseline_report(long: DataFrame) -> DataFrame:
    """(split, method, rmse, mae, n) of mean and persistence on the later splits."""
    later = metrics.mean_baseline(long.where("split = 'train'"), long.where("split <> 'train'"))
    both = F.array(*(F.struct(F.lit(m).alias("method"), F.col(c).alias("y_hat")) for m, c in (("mean", "y_hat"), ("persistence", "end_value"))))
    rows = later.withColumn("_m", F.explode(both)).drop("y_hat").select("*", "_m.method", "_m.y_hat")
    return metrics.errors(rows, ["split", "method"])


def calibration_reports(long: DataFrame, block: int) -> dict[str, DataFrame]:
    keys = ["split", "window_id"]
    return {"report": calibration.calibration_report(long, block, keys), "blocks": calibration.first_blocks(long, block, window=keys)}


def exploration(split: DataFrame, columns: Sequence[str], found: DataFrame | None = None) -> dict[str, DataFrame]:
    out = {"missing": stats.missing_rates(split, columns, ["split"]), "describe": stats.describe(split, columns, ["split"]), "pearson": stats.pearson(split, columns), "spearman": stats.spearman(split, columns)}
    return out | ({"windows": windows.window_summary(found, len(columns) - 1)} if found is not None else {})


def store(frames: dict[str, DataFrame], out: str, partitioned: dict[str, Sequence[str]] | None = None) -> None:
    for name, df in frames.items():
        write(df, f"{out}/{name}", (partitioned or {}).get(name, ()))


def store_panel(panel: DataFrame, out: str, ts: str, freq: str, agg: str, more: dict[str, str] | None = None) -> None:
    """The panel with a row of what it was made with and what it holds: out (Parquet) and, beside it, <out>_meta (JSON)."""
    write(panel, out)
    kept = panel.sparkSession.read.parquet(out)
    counts = [c for c in kept.columns if c.startswith("n_obs_")]
    found = kept.agg(F.count("*").alias("n_rows"), F.min(ts).cast("string").alias("first"), F.max(ts).cast("string").alias("last"), *(F.sum(F.col(f"`{c}`")).alias(c) for c in counts))
    settings = {"freq": freq, "agg": agg, "step_micros": freq_micros(freq), **(more or {})}
    write(found.select(*(F.lit(v).alias(k) for k, v in settings.items()), *(F.col(f"`{c}`") for c in found.columns)), f"{out}_meta", fmt="json")


def train(spark: SparkSession, stored: str, kind: str, out: str, t: training.Training = training.Training(), hidden: int = 64, patch: int = 16, scaler: str | None = None, teacher: str | None = None, target: str = TARGET) -> training.Fitted:
    """Trains on stored windows (splits train, val and, if there, test) and leaves checkpoint, log, settings and summary in out."""
    rows = windows.load(spark, stored)
    first = windows.require_windows(rows).select(F.size("future").alias("future"), "context").first()
    channels = len(rows.schema["context"].dataType.elementType.fields) - 1
    c = ForecastConfig(channels=channels, horizon=first["future"], hidden=hidden, patch=patch)
    stat = spark.read.parquet(scaler).first()["scaler"][target] if scaler else None
    mean, std = (stat["mean"], stat["std"]) if stat else (0.0, 1.0)
    part = {name: rows.where(F.col("split") == name) for name in ("train", "val", "test")}
    fitted = training.fit(part["train"], part["val"], kind, c, t, spark.read.parquet(teacher) if teacher else None, mean, std)
    residual = t.objective == "residual" and kind != "student_residual"
    test = training.evaluate(part["test"], kind, fitted.weights, c, residual, mean, std)
    training.save(spark, fitted, out, {"test_rmse_chl": test["rmse"], "test_mae_chl": test["mae"], "test_n_valid": test["n"], "checkpoint": f"{out}/checkpoint"})
    return fitted


def predictions(spark: SparkSession, stored: str, model: str) -> DataFrame:
    """Long form of stored windows with the model's y_hat, by target time."""
    kind, weights, c, t = training.load(spark, model)
    rows = windows.load(spark, stored)
    found = predict(rows, kind, weights, c, t.objective == "residual" and kind != "student_residual")
    return metrics.by_target_time(windows.long_form(rows).join(found, ["split", "window_id", "step"]))
