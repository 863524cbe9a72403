"""Command line: python -m weirflow COMMAND ...; each command reads tables or logs and writes Parquet tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weirflow.functions.scalars import resolve_freq, slug_of
from weirflow.operators import metrics, windows
from weirflow.plans import pipelines
from weirflow.sources import artifacts
from weirflow.sources.sensor_logs import FEATURES, TARGET, WEATHER, all_years, masked_series, write


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="weirflow", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict]) -> None:
        p = sub.add_parser(name)
        p.add_argument("--out", required=True)
        for flag, more in options:
            p.add_argument(flag, **more)

    logs, freq = ("--logs", {"required": True, "help": "glob of the yearly CSV files"}), ("--freq", {})
    table = ("--table", {"required": True})
    command("month-audit", logs, ("--p", {"type": float, "default": 0.8}))
    command("ground-truth", logs, freq, ("--p", {"type": float, "default": 0.8}), ("--hampel-hours", {"type": float, "default": 24.0}), ("--n-sigma", {"type": float, "default": 3.0}), ("--winsor", {"action": "store_true"}))
    command("resample", logs, freq, ("--agg", {"choices": ["median", "mean"], "default": "median"}), ("--p", {"type": float}), ("--weights", {}))
    command("split", table, ("--train-end", {"default": "2019-01-01"}), ("--val-end", {"default": "2021-01-01"}))
    command("windows", table, ("--context", {"type": int, "default": 96}), ("--shift", {"type": int, "default": 0}), ("--future", {"type": int, "default": 48}), ("--stride", {"type": int, "default": 1}), ("--max-gap", {"type": float, "default": 2.0}), ("--keep-null-targets", {"action": "store_true"}))
    command("explore", table, ("--windows", {}))
    command("baselines", table)
    command("calibrate", table, ("--kind", {"choices": ["persistence", "mean", "predictions"], "default": "persistence"}), ("--predictions", {}), ("--split", {"default": "test"}), ("--block", {"type": int, "default": 48}))
    command("correlations", logs)
    command("spans", logs, ("--variable", {"default": TARGET}), ("--year", {"type": int}))
    model = ("--kind", {"choices": ["gru", "mlp", "teacher", "student", "student_residual"], "default": "gru"})
    command("train", ("--windows", {"required": True, "help": "what the command windows wrote"}), model, ("--scaler", {"help": "scaler of the command split"}), ("--epochs", {"type": int, "default": 10}), ("--batch", {"type": int, "default": 64}), ("--rate", {"type": float, "default": 1e-3}), ("--decay", {"type": float, "default": 1e-4}), ("--clip", {"type": float, "default": 1.0}), ("--schedule", {"choices": ["plateau", "cosine", "none"], "default": "plateau"}), ("--patience", {"type": int, "default": 0}), ("--objective", {"choices": ["mse", "residual", "tdalign"], "default": "mse"}), ("--hidden", {"type": int, "default": 64}), ("--patch", {"type": int, "default": 16}), ("--teacher", {"help": "predictions of a teacher"}), ("--alpha", {"type": float, "default": 1.0}), ("--beta", {"type": float, "default": 0.0}), ("--seed", {"type": int, "default": 42}), ("--shards", {"type": int, "default": 1}))
    command("predict", ("--windows", {"required": True}), ("--model", {"required": True, "help": "what the command train wrote"}))
    command("predictions", table)
    command("snapshot", ("--root", {"required": True}))
    command("leaderboard", ("--root", {"required": True}))
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("weirflow").getOrCreate()
    read = lambda path: spark.read.parquet(path)
    if a.command in ("month-audit", "ground-truth"):
        more = {} if a.command == "month-audit" else {"freq": a.freq, "hampel_hours": a.hampel_hours, "n_sigma": a.n_sigma, "winsor": a.winsor}
        found = pipelines.ground_truth(spark, a.logs, pipelines.GroundTruth(p=a.p, **more))
        pipelines.store({k: found[k] for k in (("audit", "series") if a.command == "month-audit" else found)}, a.out)
    elif a.command == "resample":
        s = pipelines.TrainingSet(freq=a.freq, agg=a.agg, p=a.p)
        freq = resolve_freq(a.freq)
        pipelines.store_panel(pipelines.panel(spark, a.logs, s, weights=a.weights), f"{a.out}/resampled_{slug_of(freq)}", "DateTime", freq, a.agg, {"logs": a.logs})
    elif a.command == "split":
        found = pipelines.training_set(read(a.table), pipelines.TrainingSet(train_end=a.train_end, val_end=a.val_end))
        pipelines.store({k: found[k] for k in ("split", "scaler", "manifest")}, a.out, {"split": ["split"]})
    elif a.command == "windows":
        s = windows.WindowSettings(a.context, a.shift, a.future, a.stride, not a.keep_null_targets, a.max_gap)
        found = windows.require_windows(windows.sliding(read(a.table), "DateTime", [f"{c}_z" for c in FEATURES], f"{TARGET}_z", s))
        windows.store(found, f"{a.out}/windowed_L{s.context}_H{s.shift}_P{s.future}_S{s.stride}", {"upstream": a.table})
    elif a.command == "explore":
        pipelines.store(pipelines.exploration(read(a.table), [*FEATURES, TARGET], read(a.windows) if a.windows else None), a.out)
    elif a.command == "baselines":
        write(pipelines.baseline_report(windows.long_form(read(a.table))), a.out)
    elif a.command == "calibrate":
        long = windows.long_form(read(a.table))
        own = long.where(F.col("split") == a.split)
        if a.kind == "predictions":
            rows = own.join(read(a.predictions), ["split", "window_id", "step"])
        else:
            rows = metrics.persistence_baseline(own, require=True) if a.kind == "persistence" else metrics.mean_baseline(long.where("split = 'train'"), own)
        pipelines.store(pipelines.calibration_reports(rows, a.block), a.out)
    elif a.command == "correlations":
        from weirflow.operators import stats

        columns = list(dict.fromkeys([*WEATHER, *FEATURES, TARGET]))
        rows = masked_series(spark, a.logs, columns, require=True)
        pipelines.store({"pearson": stats.pearson(rows, columns), "spearman": stats.spearman(rows, columns), "complete": stats.complete_cases(rows, columns)}, a.out)
    elif a.command == "spans":
        from weirflow.operators.spans import flag_spans

        rows = all_years(spark, a.logs)
        write(flag_spans(rows.where(F.col("Year") == a.year) if a.year else rows, "DateTime", f"{a.variable}_Flag"), a.out)
    elif a.command == "train":
        from weirflow.operators import training

        pipelines.train(spark, a.windows, a.kind, a.out, training.Training(epochs=a.epochs, batch=a.batch, rate=a.rate, decay=a.decay, clip=a.clip, schedule=a.schedule, patience=a.patience, objective=a.objective, alpha=a.alpha, beta=a.beta, seed=a.seed, shards=a.shards), a.hidden, a.patch, a.scaler, a.teacher)
    elif a.command == "predict":
        write(pipelines.predictions(spark, a.windows, a.model), a.out)
    elif a.command == "predictions":
        rows = metrics.by_target_time(metrics.residuals(read(a.table)))
        pipelines.store({"residuals": rows, "errors": metrics.errors(rows), "per_step": metrics.per_step(rows)}, a.out)
    elif a.command == "snapshot":
        artifacts.snapshot(spark, a.root, a.out)
    else:
        write(artifacts.leaderboard(spark, a.root), a.out)


if __name__ == "__main__":
    main()
