"""Forecast models by numpy, run over windows in Arrow batches.

A model is a dict of arrays and a config; weights go to the executors once, as a
broadcast of a few hundred kilobytes.  Forward passes are plain array code, which
``training`` runs with gradients as well; ``fit_ridge`` fits a linear model in closed
form (its sums are one aggregation).
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

# Python workers get these functions themselves, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class ForecastConfig:
    channels: int = 5
    horizon: int = 1
    hidden: int = 64
    layers: int = 2
    patch: int = 16
    heads: int = 4
    #: Layers of the encoder of keys and values; None: as many as that of the queries.
    kv_layers: int | None = None


def _init(rng: np.random.Generator, *shape: int) -> np.ndarray:
    return rng.uniform(-1, 1, shape) / np.sqrt(shape[-1])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray) -> np.ndarray:
    x = x - x.mean(-1, keepdims=True)
    return x / np.sqrt((x * x).mean(-1, keepdims=True) + 1e-5) * gain + bias


def _dense(p: dict, name: str, x: np.ndarray) -> np.ndarray:
    return x @ p[f"{name}.w"].T + p[f"{name}.b"]


def _add(p: dict, rng, name: str, n_out: int, n_in: int) -> None:
    p[f"{name}.w"], p[f"{name}.b"] = _init(rng, n_out, n_in), np.zeros(n_out)


def gru_weights(c: ForecastConfig, seed: int = 0) -> dict[str, np.ndarray]:
    rng, p = np.random.default_rng(seed), {}
    for k in range(c.layers):
        _add(p, rng, f"in{k}", 3 * c.hidden, c.channels if k == 0 else c.hidden)
        _add(p, rng, f"re{k}", 3 * c.hidden, c.hidden)
    _add(p, rng, "head1", c.hidden, c.hidden)
    _add(p, rng, "head2", c.horizon, c.hidden)
    return p


def gru(p: dict, x: np.ndarray, valid: np.ndarray, c: ForecastConfig) -> np.ndarray:
    """(B, L, C) to (B, horizon): missing cells count as 0; gates in the order reset, update, new."""
    seq = np.where(valid, x, 0.0)
    h = None
    for k in range(c.layers):
        h, out = np.zeros((len(x), c.hidden)), []
        given = _dense(p, f"in{k}", seq)
        for t in range(seq.shape[1]):
            ir, iz, i_n = np.split(given[:, t], 3, axis=1)
            hr, hz, hn = np.split(_dense(p, f"re{k}", h), 3, axis=1)
            z, n = _sigmoid(iz + hz), np.tanh(i_n + _sigmoid(ir + hr) * hn)
            h = (1 - z) * n + z * h
            out.append(h)
        seq = np.stack(out, axis=1)
    return _dense(p, "head2", np.maximum(_dense(p, "head1", h), 0))


def mlp_weights(c: ForecastConfig, length: int, seed: int = 0) -> dict[str, np.ndarray]:
    rng, p = np.random.default_rng(seed), {}
    _add(p, rng, "head1", c.hidden, length * c.channels)
    _add(p, rng, "head2", c.hidden, c.hidden)
    _add(p, rng, "head3", c.horizon, c.hidden)
    return p


def mlp(p: dict, x: np.ndarray, valid: np.ndarray, c: ForecastConfig) -> np.ndarray:
    flat = np.where(valid, x, 0.0).reshape(len(x), -1)
    hidden = np.maximum(_dense(p, "head1", flat), 0)
    return _dense(p, "head3", np.maximum(_dense(p, "head2", hidden), 0))


def fold(x: np.ndarray, valid: np.ndarray, patch: int) -> tuple[np.ndarray, np.ndarray]:
    """(B, L, C) to patches (B, L / patch, patch * C) and whether a patch has any valid cell."""
    b, length, channels = x.shape
    if length % patch:
        raise ValueError(f"{length} steps are no multiple of the patch length {patch}")
    clean = np.where(valid & np.isfinite(x), x, 0.0)
    return clean.reshape(b, length // patch, patch * channels), valid.reshape(b, length // patch, -1).any(axis=2)


def padding(there: np.ndarray) -> np.ndarray:
    """What attention leaves out; a row of padding alone keeps its last slot."""
    out = ~there
    out[out.all(axis=1), -1] = False
    return out


def _attend(p: dict, name: str, q: np.ndarray, kv: np.ndarray, pad: np.ndarray, heads: int) -> np.ndarray:
    b, n, d = q.shape
    cut = lambda x: x.reshape(b, -1, heads, d // heads).transpose(0, 2, 1, 3)
    qs, ks, vs = cut(_dense(p, f"{name}.q", q)), cut(_dense(p, f"{name}.k", kv)), cut(_dense(p, f"{name}.v", kv))
    score = qs @ ks.transpose(0, 1, 3, 2) / np.sqrt(d // heads)
    score = np.where(pad[:, None, None, :], -np.inf, score)
    score = np.exp(score - score.max(-1, keepdims=True))
    mixed = (score / score.sum(-1, keepdims=True)) @ vs
    return _dense(p, f"{name}.o", mixed.transpose(0, 2, 1, 3).reshape(b, n, d))


def _encode(p: dict, name: str, x: np.ndarray, pad: np.ndarray, c: ForecastConfig, layers: int) -> np.ndarray:
    for k in range(layers):
        x = _norm(x + _attend(p, f"{name}{k}", x, x, pad, c.heads), p[f"{name}{k}.g1"], p[f"{name}{k}.n1"])
        x = _norm(x + _dense(p, f"{name}{k}.f2", np.maximum(_dense(p, f"{name}{k}.f1", x), 0)), p[f"{name}{k}.g2"], p[f"{name}{k}.n2"])
    return x


def attention_weights(c: ForecastConfig, student: bool = False, shared: bool = False, seed: int = 0, residual: bool = False) -> dict[str, np.ndarray]:
    """Teacher: queries from the channels, keys and values from channels and target.  Student: both from the channels.

    residual adds the student's head of the end value; there a shared encoder still has its own embedding of keys and values.
    """
    if residual and not student:
        raise ValueError("only a student estimates the end value")
    rng, p, d = np.random.default_rng(seed), {}, c.hidden
    sides = {"q": c.channels} | ({} if shared else {"kv": c.channels if student else c.channels + 1})
    for side, channels in sides.items():
        _add(p, rng, f"embed_{side}", d, c.patch * channels)
        for k in range(c.layers if side == "q" or c.kv_layers is None else c.kv_layers):
            for part in "qkvo":
                _add(p, rng, f"enc_{side}{k}.{part}", d, d)
            _add(p, rng, f"enc_{side}{k}.f1", 4 * d, d)
            _add(p, rng, f"enc_{side}{k}.f2", d, 4 * d)
            for i in (1, 2):
                p[f"enc_{side}{k}.g{i}"], p[f"enc_{side}{k}.n{i}"] = np.ones(d), np.zeros(d)
    for part in "qkvo":
        _add(p, rng, f"cross.{part}", d, d)
    p["norm.g"], p["norm.b"] = np.ones(d), np.zeros(d)
    _add(p, rng, "head1", d, d)
    _add(p, rng, "head2", c.horizon, d)
    if residual:
        _add(p, rng, "end1", d, d)
        _add(p, rng, "end2", 1, d)
        if shared:
            _add(p, rng, "embed_kv", d, c.patch * c.channels)
    return p


def attention(p: dict, x: np.ndarray, valid: np.ndarray, c: ForecastConfig, target: np.ndarray | None = None, target_valid: np.ndarray | None = None) -> np.ndarray:
    """Cross attention over patches.  target (B, L) makes it the teacher; without it keys and values come from the channels."""
    return _dense(p, "head2", np.maximum(_dense(p, "head1", _pooled(p, x, valid, c, target, target_valid)), 0))


def attention_residual(p: dict, x: np.ndarray, valid: np.ndarray, c: ForecastConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(y_hat, end_hat, delta) of the student that estimates the end value itself, from the channels alone; y_hat is end_hat + delta."""
    pooled = _pooled(p, x, valid, c)
    end = _dense(p, "end2", np.maximum(_dense(p, "end1", pooled), 0))
    delta = _dense(p, "head2", np.maximum(_dense(p, "head1", pooled), 0))
    return end + delta, end[:, 0], delta


def _pooled(p: dict, x: np.ndarray, valid: np.ndarray, c: ForecastConfig, target: np.ndarray | None = None, target_valid: np.ndarray | None = None) -> np.ndarray:
    def side(name: str, values: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        patches, there = fold(values, ok, c.patch)
        pad = padding(there)
        own = f"enc_{name}" if f"enc_{name}0.f1.w" in p else "enc_q"
        layers = c.layers if own == "enc_q" or c.kv_layers is None else c.kv_layers
        return _encode(p, own, _dense(p, f"embed_{name}", patches), pad, c, layers), pad

    q, q_pad = side("q", x, valid)
    if target is not None:
        kv, pad = side("kv", np.concatenate([x, target[..., None]], axis=2), np.concatenate([valid, target_valid[..., None]], axis=2))
    elif "embed_kv.w" in p:
        kv, pad = side("kv", x, valid)
    else:
        kv, pad = q, q_pad
    return _norm(q + _attend(p, "cross", q, kv, pad, c.heads), p["norm.g"], p["norm.b"]).mean(axis=1)


def cells(column: pa.ListArray, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(rows, steps, names) of a column of arrays of structs, and whether each cell is a finite number."""
    flat = column.flatten()
    x = np.stack([np.asarray(flat.field(n).to_numpy(zero_copy_only=False), float) for n in names], axis=1).reshape(len(column), -1, len(names))
    return x, np.isfinite(x)


def predict(windows: DataFrame, kind: str, weights: dict[str, np.ndarray], c: ForecastConfig, residual: bool = False, keys: tuple[str, ...] = ("split",)) -> DataFrame:
    """(keys, window_id, step, y_hat) of each window.  kind: gru, mlp, teacher, student or student_residual.

    residual adds the observed end value (0 if missing), which a student of the
    channels does not see; student_residual adds its own estimate instead and
    has the further columns end_hat and delta.
    """
    runs = {"gru": gru, "mlp": mlp, "student": attention, "teacher": attention, "student_residual": attention_residual}
    if kind not in runs:
        raise ValueError(f"kind must be one of {sorted(runs)}")
    if residual and kind in ("student", "student_residual"):
        raise ValueError("a student does not see the end value; student_residual estimates it")
    own_end = kind == "student_residual"
    sent = windows.sparkSession.sparkContext.broadcast(weights)
    schema = windows.select(*keys, "window_id").schema.add("y_hats", ArrayType(DoubleType()))
    if own_end:
        schema = schema.add("end_hat", DoubleType()).add("deltas", ArrayType(DoubleType()))
    names = [*(f"f{i}" for i in range(c.channels)), "y"]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ok = cells(batch.column(len(keys) + 2), names)
            more = {"target": x[..., -1], "target_valid": ok[..., -1]} if kind == "teacher" else {}
            y = runs[kind](p, x[..., :-1], ok[..., :-1], c, **more)
            if residual:
                y = y + np.nan_to_num(np.asarray(batch.column(len(keys) + 1).to_numpy(zero_copy_only=False), float))[:, None]
            more_out = []
            if own_end:
                y, end, delta = y
                more_out = [pa.array(end), pa.array(list(delta), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], pa.array(list(y), pa.list_(pa.float64())), *more_out], schema.names)

    found = windows.select(*keys, "window_id", "end_value", "context").mapInArrow(each, schema)
    if own_end:
        steps = found.select(*keys, "window_id", "end_hat", "deltas", F.posexplode("y_hats").alias("step", "y_hat"))
        return steps.select(*keys, "window_id", "step", "y_hat", "end_hat", F.get("deltas", "step").alias("delta"))
    return found.select(*keys, "window_id", F.posexplode("y_hats").alias("step", "y_hat"))


def fit_ridge(windows: DataFrame, c: ForecastConfig, penalty: float = 1.0) -> dict[str, np.ndarray]:
    """A linear model of the last context row (missing as 0, and 1) for each step: sums of products per partition, added up.

    What comes to the driver is one matrix for each partition group: (channels + 2) squared numbers.
    """
    size, names = c.channels + 2, [*(f"f{i}" for i in range(c.channels)), "y"]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xx, xy = np.zeros((size, size)), np.zeros((size, c.horizon))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ok = cells(batch.column(0), names)
            y = cells(batch.column(1), ["y"])[0][..., 0]
            rows = np.concatenate([np.where(ok[:, -1], x[:, -1], 0.0), np.ones((len(x), 1))], axis=1)
            kept = np.isfinite(y).all(axis=1)
            xx += rows[kept].T @ rows[kept]
            xy += rows[kept].T @ y[kept]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(size * (size + c.horizon)), pa.int32()), "v": np.concatenate([xx.ravel(), xy.ravel()])})

    sums = windows.select("context", "future").mapInArrow(each, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()
    v = np.asarray(sums.column("v"))
    xx, xy = v[: size * size].reshape(size, size), v[size * size :].reshape(size, c.horizon)
    return {"w": np.linalg.solve(xx + penalty * np.eye(size), xy)}


class EarlyStopping:
    """Best so far on a metric log: an epoch counts if it improves by more than min_delta; stops after patience others.  Sequential, a few numbers, on the driver."""

    def __init__(self, patience: int = 8, min_delta: float = 0.0):
        self.patience, self.min_delta, self.best, self.best_epoch, self.waited = patience, min_delta, float("inf"), -1, 0

    def step(self, epoch: int, metric: float) -> bool:
        """Whether to stop after this epoch; a metric that is not finite never improves."""
        if np.isfinite(metric) and metric < self.best - self.min_delta:
            self.best, self.best_epoch, self.waited = metric, epoch, 0
        else:
            self.waited += 1
        return self.waited >= self.patience
