"""Gradient training of the forecast models over windows.

Windows are dealt to a fixed number of shards by a hash of their keys.  In an
epoch each shard takes AdamW steps over its windows from the same weights; the
shards' weights and moments are averaged in proportion to their steps.  One shard
is plain training in order.  After each epoch the model runs over the validation
windows and the metric decides on the learning rate, the best weights and the end.

A shard's windows are one task's arrays (L * (channels + 1) + 3 * P numbers each),
so `shards` bounds the windows that a task holds; what comes to the driver is a
model for each shard.
"""

from __future__ import annotations

import json
import math
import sys
import time
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators import metrics
from weirflow.operators.gradients import Tensor, value
from weirflow.operators.models import EarlyStopping, ForecastConfig, attention, attention_residual, attention_weights, cells, gru, gru_weights, mlp, mlp_weights, predict
from weirflow.operators.windows import long_form

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Training:
    epochs: int = 10
    batch: int = 64
    rate: float = 1e-3
    decay: float = 1e-4
    #: Largest norm of a step's gradient; 0: any.
    clip: float = 1.0
    #: plateau, cosine or none.
    schedule: str = "plateau"
    plateau_patience: int = 2
    plateau_factor: float = 0.5
    least_rate: float = 1e-6
    #: Epochs without improvement before the end; 0: all epochs.
    patience: int = 0
    min_delta: float = 1e-4
    #: mse, residual (the change from the end value) or tdalign.
    objective: str = "mse"
    #: Distillation: weight of the targets against the teacher, and of the end value's error.
    alpha: float = 1.0
    beta: float = 0.0
    seed: int = 42
    shards: int = 1

    def __post_init__(self):
        if self.objective not in ("mse", "residual", "tdalign") or self.schedule not in ("plateau", "cosine", "none"):
            raise ValueError("objective must be mse, residual or tdalign, schedule plateau, cosine or none")


def new_weights(kind: str, c: ForecastConfig, length: int, seed: int = 0) -> dict[str, np.ndarray]:
    makers = {
        "gru": lambda: gru_weights(c, seed),
        "mlp": lambda: mlp_weights(c, length, seed),
        "teacher": lambda: attention_weights(c, seed=seed),
        "student": lambda: attention_weights(c, student=True, seed=seed),
        "student_residual": lambda: attention_weights(c, student=True, residual=True, seed=seed),
    }
    if kind not in makers:
        raise ValueError(f"kind must be one of {sorted(makers)}")
    return makers[kind]()


def squared(p, y: np.ndarray, w: np.ndarray):
    """Weighted mean of squares where w is positive; None without any."""
    total = w.sum()
    if not total > 0:
        return None
    e = p - y
    return (e * e * w).sum() * (1 / total)


def aligned(p, y: np.ndarray, end: np.ndarray, w: np.ndarray):
    """rho * level + (1 - rho) * difference, rho the part of steps whose differences have not the same sign."""
    level = squared(p, np.where(w > 0, y, 0.0), w)
    if level is None:
        return None
    dy = y - np.concatenate([end[:, None], y[:, :-1]], axis=1)
    dp = p - np.concatenate([np.where(np.isfinite(end), end, 0.0)[:, None], p[:, :-1]], axis=1)
    ok = (w > 0) & np.isfinite(dy)
    difference = squared(dp, np.where(ok, dy, 0.0), np.where(ok, w, 0.0))
    if difference is None:
        return level
    rho = float((np.sign(dy[ok]) != np.sign(value(dp)[ok])).mean())
    return level * rho + difference * (1 - rho)


def loss_of(kind: str, p, rows: dict[str, np.ndarray], c: ForecastConfig, t: Training):
    """The loss of some windows as a number with a gradient; None where nothing counts."""
    x, ok, y, w, end = rows["x"], rows["ok"], rows["y"], rows["w"], rows["end"]
    w = np.where(np.isfinite(y), w, 0.0)
    known = np.isfinite(end)
    raw, y = y, np.where(w > 0, y, 0.0)
    if t.objective == "residual":  # a change needs an end value
        w = w * known[:, None]
    base = np.where(known, end, 0.0)[:, None] if t.objective == "residual" else 0.0
    end_hat = None
    if kind == "student_residual":
        out, end_hat, delta = attention_residual(p, x[..., :-1], ok[..., :-1], c)
        out = delta if t.objective == "residual" else out
    elif kind == "teacher":
        out = attention(p, x[..., :-1], ok[..., :-1], c, x[..., -1], ok[..., -1])
    else:
        out = {"gru": gru, "mlp": mlp, "student": attention}[kind](p, x[..., :-1], ok[..., :-1], c)
    own = aligned(out, raw, end, w) if t.objective == "tdalign" else squared(out, y - base, w)
    if own is None:
        return None
    if "guide" in rows and t.alpha < 1:
        guide = rows["guide"]
        there = np.where(np.isfinite(guide), w, 0.0)
        led = squared(out, np.where(there > 0, guide - base, 0.0), there)
        own = own if led is None else own * t.alpha + led * (1 - t.alpha)
    if end_hat is not None and t.beta and known.any():
        e = end_hat - np.where(known, end, 0.0)
        own = own + (e * e * known).sum() * (t.beta / known.sum())
    return own


def gradients(kind: str, p: dict[str, np.ndarray], rows: dict[str, np.ndarray], c: ForecastConfig, t: Training) -> tuple[float, dict[str, np.ndarray]] | None:
    """(loss, gradient of each weight), or None where nothing counts or something is not finite."""
    tensors = {k: Tensor(v) for k, v in p.items()}
    loss = loss_of(kind, tensors, rows, c, t)
    if loss is None or not np.isfinite(loss.data):
        return None
    loss.backward()
    found = {k: v.grad if v.grad is not None else np.zeros_like(v.data) for k, v in tensors.items()}
    return (float(loss.data), found) if all(np.isfinite(g).all() for g in found.values()) else None


@dataclass
class State:
    """Weights and AdamW's moments."""

    weights: dict[str, np.ndarray]
    first: dict[str, np.ndarray] = field(default_factory=dict)
    second: dict[str, np.ndarray] = field(default_factory=dict)
    steps: int = 0

    def step(self, g: dict[str, np.ndarray], rate: float, t: Training) -> None:
        norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = t.clip / norm if t.clip and norm > t.clip else 1.0
        self.steps += 1
        for k, x in g.items():
            x = x * scale
            self.first[k] = 0.9 * self.first.get(k, 0.0) + 0.1 * x
            self.second[k] = 0.999 * self.second.get(k, 0.0) + 0.001 * x * x
            m, v = self.first[k] / (1 - 0.9**self.steps), self.second[k] / (1 - 0.999**self.steps)
            self.weights[k] = self.weights[k] * (1 - rate * t.decay) - rate * m / (np.sqrt(v) + 1e-8)


def _arrays(batch: pa.RecordBatch, c: ForecastConfig) -> dict[str, np.ndarray]:
    """From columns context, future, end_value and, for distillation, guide."""
    x, ok = cells(batch.column("context"), [*(f"f{i}" for i in range(c.channels)), "y"])
    future, _ = cells(batch.column("future"), ["y", "w"])
    rows = {"x": x, "ok": ok, "y": future[..., 0], "w": np.nan_to_num(future[..., 1]), "end": np.asarray(batch.column("end_value").to_numpy(zero_copy_only=False), float)}
    if "guide" in batch.schema.names:
        rows["guide"] = np.asarray(batch.column("guide").flatten().to_numpy(zero_copy_only=False), float).reshape(len(x), -1)
    return rows


def _epoch(windows: DataFrame, kind: str, state: State, rate: float, c: ForecastConfig, t: Training, number: int) -> tuple[State, float]:
    """The state after an epoch over all shards, and the mean loss of its steps."""
    sent = windows.sparkSession.sparkContext.broadcast((state.weights, state.first, state.second, state.steps))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, first, second, steps = sent.value
        own = State(dict(weights), dict(first), dict(second), steps)
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        table = pa.Table.from_batches(found).combine_chunks()
        table = table.sort_by("order_").drop_columns(["order_"])
        parts = [_arrays(b, c) for b in table.to_batches()]
        rows = {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}
        losses, order = [], np.random.default_rng([t.seed, number]).permutation(len(rows["x"]))
        for i in range(0, len(order), t.batch):
            got = gradients(kind, own.weights, {k: v[order[i : i + t.batch]] for k, v in rows.items()}, c, t)
            if got is not None:
                losses.append(got[0])
                own.step(got[1], rate, t)
        if losses:
            for part, values in (("weights", own.weights), ("first", own.first), ("second", own.second)):
                for k, v in values.items():
                    yield pa.RecordBatch.from_pydict({"part": [part], "name": [k], "n": [len(losses)], "loss": [float(np.mean(losses))], "data": pa.array([np.asarray(v, "<f8").tobytes()], pa.binary())})

    dealt = windows.repartitionById(t.shards, F.pmod(F.col("order_"), F.lit(t.shards)).cast("int"))
    sums: dict[tuple[str, str], np.ndarray] = {}
    count, loss = {}, 0.0
    for row in dealt.mapInArrow(each, "part string, name string, n long, loss double, data binary").toLocalIterator():
        key = row["part"], row["name"]
        sums[key] = sums.get(key, 0.0) + np.frombuffer(row["data"], "<f8").reshape(state.weights[row["name"]].shape) * row["n"]
        count[key] = count.get(key, 0) + row["n"]
        if key == ("weights", next(iter(state.weights))):
            loss += row["loss"] * row["n"]
    sent.unpersist()
    if not sums:
        return state, float("nan")
    mean = {part: {k: v / count[p, k] for (p, k), v in sums.items() if p == part} for part in ("weights", "first", "second")}
    total = count["weights", next(iter(state.weights))]
    return State(mean["weights"], mean["first"], mean["second"], state.steps + max(1, round(total / t.shards))), loss / total


def evaluate(windows: DataFrame, kind: str, weights: dict[str, np.ndarray], c: ForecastConfig, residual: bool = False, mean: float = 0.0, std: float = 1.0, keys: Sequence[str] = ("split",)) -> dict[str, float]:
    """rmse, mae and n of the model on windows, in the target's unit (mean and std of its scaler)."""
    back = lambda name: F.col(name) * std + mean
    rows = long_form(windows, keys).join(predict(windows, kind, weights, c, residual, tuple(keys)), [*keys, "window_id", "step"])
    found = metrics.errors(rows.withColumns({"y": back("y"), "y_hat": back("y_hat")})).first()
    return {"rmse": found["rmse"] if found["n"] else float("nan"), "mae": found["mae"] if found["n"] else float("nan"), "n": found["n"]}


@dataclass
class Fitted:
    weights: dict[str, np.ndarray]
    #: A row for each epoch: epoch, train_loss, val_rmse, val_mae, val_n, rate, seconds.
    log: list[dict]
    best_epoch: int
    best_rmse: float
    stopped: str
    kind: str
    config: ForecastConfig
    training: Training


def fit(train: DataFrame, val: DataFrame, kind: str, c: ForecastConfig, t: Training = Training(), teacher: DataFrame | None = None, mean: float = 0.0, std: float = 1.0, keys: Sequence[str] = ("split",)) -> Fitted:
    """Trains on windows and keeps the weights of the best validation RMSE.

    teacher: predictions (keys, window_id, step, y_hat) in levels that a student learns from by 1 - alpha.
    """
    length = train.select(F.size("context")).first()
    if length is None:
        raise ValueError("no window to train on")
    own = train.select(*keys, "window_id", "context", "future", "end_value")
    if teacher is not None:
        guides = teacher.groupBy(*keys, "window_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "y_hat"))), lambda s: s["y_hat"]).alias("guide"))
        own = own.join(guides, [*keys, "window_id"])
    own = own.withColumn("order_", F.xxhash64(*keys, "window_id")).drop(*keys, "window_id").persist()
    state, rate = State(new_weights(kind, c, length[0], t.seed)), t.rate
    stop, log, best, stale = EarlyStopping(t.patience or 10**9, t.min_delta), [], state.weights, 0
    lowest, stopped = float("inf"), "max_epochs"
    residual = t.objective == "residual" and kind != "student_residual"
    try:
        for number in range(1, t.epochs + 1):
            began = time.perf_counter()
            state, loss = _epoch(own, kind, state, rate, c, t, number)
            found = evaluate(val, kind, state.weights, c, residual, mean, std, keys)
            log.append({"epoch": number, "train_loss": loss, "val_rmse": found["rmse"], "val_mae": found["mae"], "val_n": found["n"], "rate": rate, "seconds": round(time.perf_counter() - began, 2)})
            over = stop.step(number, found["rmse"])
            if stop.best_epoch == number:
                best = state.weights
            if t.schedule == "cosine":
                rate = t.least_rate + (t.rate - t.least_rate) * (1 + math.cos(math.pi * number / t.epochs)) / 2
            elif t.schedule == "plateau":
                better = found["rmse"] < lowest * (1 - 1e-4)
                lowest, stale = (found["rmse"], 0) if better else (lowest, stale + 1)
                if stale > t.plateau_patience:
                    rate, stale = max(rate * t.plateau_factor, t.least_rate), 0
            if t.patience and over:
                stopped = f"early_stopping_{t.patience}"
                break
    finally:
        own.unpersist()
    return Fitted(best, log, stop.best_epoch, stop.best, stopped, kind, c, t)


# -- what training leaves -----------------------------------------------------------------------------------------


def save(spark: SparkSession, fitted: Fitted, out: str, summary: dict | None = None) -> None:
    """out/checkpoint (weights), out/log, out/settings and, with a summary, out/<kind>_eval_summary.json."""
    rows = [(k, list(v.shape), [float(x) for x in v.ravel()]) for k, v in fitted.weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").coalesce(1).write.mode("overwrite").parquet(f"{out}/checkpoint")
    log = "epoch int, train_loss double, val_rmse double, val_mae double, val_n long, rate double, seconds double"
    spark.createDataFrame([tuple(r.values()) for r in fitted.log], log).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{out}/log")
    settings = {"kind": fitted.kind, "config": asdict(fitted.config), "training": asdict(fitted.training), "best_epoch": fitted.best_epoch, "best_val_rmse": fitted.best_rmse, "stopped_reason": fitted.stopped}
    spark.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/settings")
    if summary is not None:
        from weirflow.sources.scratch import one_file

        text = json.dumps({"best_epoch": fitted.best_epoch, "val_rmse_chl": fitted.best_rmse, "stopped_reason": fitted.stopped, **summary})
        one_file(spark.createDataFrame([(text,)], "value string"), f"{out}/{fitted.kind}_eval_summary.json", "text")


def load(spark: SparkSession, out: str) -> tuple[str, dict[str, np.ndarray], ForecastConfig, Training]:
    """(kind, weights, config, settings) of what save() wrote."""
    settings = json.loads(spark.read.option("wholetext", True).text(f"{out}/settings").first()["value"])
    rows = spark.read.parquet(f"{out}/checkpoint").collect()
    weights = {r["name"]: np.array(r["data"]).reshape(r["shape"]) for r in rows}
    return settings["kind"], weights, ForecastConfig(**settings["config"]), Training(**settings["training"])
