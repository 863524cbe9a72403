"""Gradients against differences, forward passes against loops, training, checkpoints and the commands."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.operators import models, training, windows
from weirflow.operators.models import ForecastConfig

KINDS = ("gru", "mlp", "teacher", "student", "student_residual")


def some_rows(rng, b, length, channels, horizon):
    x = rng.normal(size=(b, length, channels + 1))
    x[rng.random(x.shape) < 0.2] = np.nan
    y = rng.normal(size=(b, horizon))
    y[0, 0] = np.nan
    end = rng.normal(size=b)
    end[1] = np.nan
    return {"x": x, "ok": np.isfinite(x), "y": y, "w": rng.choice([0.0, 0.5, 1.0], size=(b, horizon)), "end": end, "guide": rng.normal(size=(b, horizon))}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("objective", ["mse", "residual", "tdalign"])
def test_gradients_equal_differences(kind, objective):
    rng = np.random.default_rng(1)
    c = ForecastConfig(channels=2, horizon=3, hidden=4, layers=1 if kind != "gru" else 2, patch=2, heads=2)
    t = training.Training(objective=objective, alpha=0.6, beta=0.3)
    rows = some_rows(rng, 5, 6, 2, 3)
    p = training.new_weights(kind, c, 6, seed=3)
    p = {k: v + 0.05 * rng.normal(size=v.shape) for k, v in p.items()}
    loss, found = training.gradients(kind, p, rows, c, t)
    for name, g in found.items():
        at = tuple(rng.integers(0, n) for n in g.shape)
        ends = []
        for sign in (1, -1):
            moved = {k: v.copy() for k, v in p.items()}
            moved[name][at] += sign * 1e-6
            ends.append(float(training.value(training.loss_of(kind, moved, rows, c, t))))
        assert g[at] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-3, abs=1e-6), name
    assert np.isfinite(loss)
    assert training.gradients(kind, p, rows | {"w": np.zeros_like(rows["w"])}, c, t) is None


def dense(p, name, v):
    w, b = p[f"{name}.w"], p[f"{name}.b"]
    return [sum(w[i][j] * v[j] for j in range(len(v))) + b[i] for i in range(len(b))]


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def plain_gru(p, x, c):
    """One window, number by number."""
    seq = [[0.0 if v != v else v for v in row] for row in x]
    for k in range(c.layers):
        h, out = [0.0] * c.hidden, []
        for row in seq:
            a, b = dense(p, f"in{k}", row), dense(p, f"re{k}", h)
            n = c.hidden
            r = [sigmoid(a[i] + b[i]) for i in range(n)]
            z = [sigmoid(a[n + i] + b[n + i]) for i in range(n)]
            new = [math.tanh(a[2 * n + i] + r[i] * b[2 * n + i]) for i in range(n)]
            h = [(1 - z[i]) * new[i] + z[i] * h[i] for i in range(n)]
            out.append(h)
        seq = out
    return dense(p, "head2", [max(v, 0) for v in dense(p, "head1", seq[-1])])


def plain_norm(v, gain, bias):
    m = sum(v) / len(v)
    s = math.sqrt(sum((x - m) ** 2 for x in v) / len(v) + 1e-5)
    return [(x - m) / s * g + b for x, g, b in zip(v, gain, bias, strict=True)]


def plain_attend(p, name, q, kv, pad, heads):
    d = len(q[0])
    size, out = d // heads, []
    keys, values = [dense(p, f"{name}.k", v) for v in kv], [dense(p, f"{name}.v", v) for v in kv]
    for v in q:
        query, mixed = dense(p, f"{name}.q", v), []
        for head in range(heads):
            cut = slice(head * size, (head + 1) * size)
            scores = [-math.inf if out_ else sum(a * b for a, b in zip(query[cut], k[cut], strict=True)) / math.sqrt(size) for k, out_ in zip(keys, pad, strict=True)]
            e = [math.exp(s - max(scores)) for s in scores]
            mixed += [sum(w * val[cut][i] for w, val in zip(e, values, strict=True)) / sum(e) for i in range(size)]
        out.append(dense(p, f"{name}.o", mixed))
    return out


def plain_side(p, side, rows, c):
    patches, pad = [], []
    for k in range(0, len(rows), c.patch):
        own = rows[k : k + c.patch]
        patches.append([0.0 if v != v else v for row in own for v in row])
        pad.append(all(v != v for row in own for v in row))
    if all(pad):
        pad[-1] = False
    own = f"enc_{side}" if f"enc_{side}0.f1.w" in p else "enc_q"
    x = [dense(p, f"embed_{side}", v) for v in patches]
    for k in range(c.layers):
        a = plain_attend(p, f"{own}{k}", x, x, pad, c.heads)
        x = [plain_norm([u + v for u, v in zip(s, t, strict=True)], p[f"{own}{k}.g1"], p[f"{own}{k}.n1"]) for s, t in zip(x, a, strict=True)]
        f = [dense(p, f"{own}{k}.f2", [max(v, 0) for v in dense(p, f"{own}{k}.f1", s)]) for s in x]
        x = [plain_norm([u + v for u, v in zip(s, t, strict=True)], p[f"{own}{k}.g2"], p[f"{own}{k}.n2"]) for s, t in zip(x, f, strict=True)]
    return x, pad


def plain_attention(p, x, c, teacher, residual):
    channels = [row[:-1] for row in x]
    q, q_pad = plain_side(p, "q", channels, c)
    kv, pad = plain_side(p, "kv", x if teacher else channels, c)
    a = plain_attend(p, "cross", q, kv, pad, c.heads)
    y = [plain_norm([u + v for u, v in zip(s, t, strict=True)], p["norm.g"], p["norm.b"]) for s, t in zip(q, a, strict=True)]
    pooled = [sum(v[i] for v in y) / len(y) for i in range(len(y[0]))]
    head = lambda name: dense(p, f"{name}2", [max(v, 0) for v in dense(p, f"{name}1", pooled)])
    return head("head"), head("end")[0] if residual else None


@pytest.mark.parametrize("kind", KINDS)
def test_forward_passes_equal_loops(kind):
    rng = np.random.default_rng(2)
    c = ForecastConfig(channels=2, horizon=3, hidden=4, layers=2, patch=3, heads=2)
    rows = some_rows(rng, 4, 9, 2, 3)
    rows["x"][2, :6, :2] = np.nan
    x, ok = rows["x"], np.isfinite(rows["x"])
    p = {k: v + 0.1 * rng.normal(size=v.shape) for k, v in training.new_weights(kind, c, 9, seed=5).items()}
    if kind == "gru":
        got, want = models.gru(p, x[..., :-1], ok[..., :-1], c), [plain_gru(p, w[:, :-1].tolist(), c) for w in x]
    elif kind == "mlp":
        flat = lambda w: [0.0 if v != v else v for row in w for v in row[:-1]]
        relu = lambda v: [max(a, 0) for a in v]
        got, want = models.mlp(p, x[..., :-1], ok[..., :-1], c), [dense(p, "head3", relu(dense(p, "head2", relu(dense(p, "head1", flat(w.tolist())))))) for w in x]
    elif kind == "student_residual":
        y, end, delta = models.attention_residual(p, x[..., :-1], ok[..., :-1], c)
        plain = [plain_attention(p, w.tolist(), c, False, True) for w in x]
        assert np.allclose(delta, [d for d, _ in plain]) and np.allclose(end, [e for _, e in plain])
        got, want = y, [[e + v for v in d] for d, e in plain]
    else:
        more = (x[..., -1], ok[..., -1]) if kind == "teacher" else ()
        got, want = models.attention(p, x[..., :-1], ok[..., :-1], c, *more), [plain_attention(p, w.tolist(), c, kind == "teacher", False)[0] for w in x]
    assert np.allclose(got, want)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Windows of a series that its channels tell: a wave, with gaps."""
    n = F.col("id")
    wave = lambda lag: F.sin((n + lag) / 5.0)
    rows = spark.range(900).select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int") * 30)).alias("ts"),
        F.when(n < 500, "train").when(n < 700, "val").otherwise("test").alias("split"),
        F.when(n % 17 != 0, wave(1)).alias("a"),
        wave(3).alias("b"),
        F.when(n % 23 != 0, wave(0)).alias("y"),
    )
    out = f"file://{tmp_path_factory.mktemp('windows')}"
    windows.store(windows.sliding(rows, "ts", ["a", "b"], "y", windows.WindowSettings(context=12, future=3, stride=2, max_gap=None)), out)
    return out


@pytest.mark.parametrize("kind,objective,shards", [("gru", "mse", 1), ("teacher", "residual", 1), ("student_residual", "residual", 2), ("mlp", "tdalign", 3)])
def test_training_learns(spark, stored, kind, objective, shards, tmp_path):
    from weirflow.plans import pipelines

    t = training.Training(epochs=6, batch=16, rate=1e-2, objective=objective, shards=shards, beta=0.5)
    fitted = pipelines.train(spark, stored, kind, f"file://{tmp_path}/m", t, hidden=8, patch=4)
    losses = [r["train_loss"] for r in fitted.log]
    assert len(losses) == 6 and losses[-1] < 0.6 * losses[0]
    assert fitted.best_rmse == min(r["val_rmse"] for r in fitted.log) < fitted.log[0]["val_rmse"] and fitted.best_rmse < 0.5
    again_kind, weights, c, settings = training.load(spark, f"file://{tmp_path}/m")
    assert again_kind == kind and settings == t and all(np.array_equal(weights[k], v) for k, v in fitted.weights.items())
    rows = pipelines.predictions(spark, stored, f"file://{tmp_path}/m").collect()
    assert [r.ts for r in rows] == sorted(r.ts for r in rows)
    val = [(r.y_hat - r.y) ** 2 for r in rows if r.split == "val" and r.y is not None]
    assert math.sqrt(sum(val) / len(val)) == pytest.approx(fitted.best_rmse)
    from weirflow.sources import artifacts

    assert artifacts.leaderboard(spark, f"file://{tmp_path}").first().val_rmse == pytest.approx(fitted.best_rmse)


def test_a_student_learns_from_a_teacher_and_stops_early(spark, stored):
    rows = windows.load(spark, stored)
    c = ForecastConfig(channels=2, horizon=3, hidden=8, layers=1, patch=4, heads=2)
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    truth = windows.long_form(train).select("split", "window_id", "step", F.coalesce("y", F.lit(0.0)).alias("y_hat"))
    t = training.Training(epochs=8, batch=16, rate=1e-2, alpha=0.0, schedule="cosine", patience=2, min_delta=10.0)
    fitted = training.fit(train, val, "student", c, t, truth)
    assert fitted.stopped == "early_stopping_2" and len(fitted.log) == 3 and fitted.best_epoch == 1
    assert fitted.log[1]["rate"] < fitted.log[0]["rate"] and fitted.log[-1]["train_loss"] < fitted.log[0]["train_loss"]
    with pytest.raises(ValueError):
        training.fit(train.where("false"), val, "gru", c)


def test_equal_runs_give_equal_weights(spark, stored):
    rows = windows.load(spark, stored)
    c = ForecastConfig(channels=2, horizon=3, hidden=4, layers=1)
    t = training.Training(epochs=2, batch=16)
    runs = [training.fit(rows.where("split = 'train'").repartition(n), rows.where("split = 'val'"), "gru", c, t).weights for n in (2, 5)]
    assert all(np.allclose(runs[0][k], runs[1][k]) for k in runs[0])
