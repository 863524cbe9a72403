"""The operators against plain Python on small data, edge cases first."""

import datetime as dt
import math
import random
from statistics import median

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weirflow.functions import scalars as S
from weirflow.operators import calendar, calibration, metrics, models, outliers, resample, spans, splits, stats, windows
from weirflow.operators.ordering import keep_first, numbered, percentiles
from weirflow.operators.quality_flags import drop_flagged, mask_flagged

T0 = dt.datetime(2024, 1, 1)


def series(spark, values, step=600):
    rows = [(i, T0 + dt.timedelta(seconds=step * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, ts timestamp_ntz, v double")


def test_scalars(spark):
    assert S.freq_micros("30min") == 1_800_000_000 and S.freq_micros("7h") == 25_200_000_000 and S.freq_micros("d") == 86_400_000_000
    for bad in ("1M", "0min", "min30", "", "-5s"):
        with pytest.raises(ValueError):
            S.freq_micros(bad)
    assert S.hampel_rows(24, "30min") == 49 and S.hampel_rows(0.1, "1h") == 7
    assert S.slug_of("a/b  c") == "a_b_c" and S.slug_of("//") == "custom"
    row = spark.sql("select ' C ' f, '' e, 'x' bad, '2.5' num, 'NaN' nan, '2024-02-30' day").select(
        S.flag(F.col("f")), S.flag(F.col("e")), S.to_number(F.col("bad")), S.to_number(F.col("num")), S.to_number(F.col("nan")), S.parse_time(F.col("day")), S.weight(F.lit(3.0)), S.weight(F.lit(None).cast("double")),
        S.slug(F.lit(" 30 min/x ")), S.slug(F.lit("--")), S.annotation(F.lit(0.001)), S.annotation(F.lit(float("nan"))), S.annotation(F.lit(1.234)), S.clip(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0)),
    ).first()
    assert list(row) == ["C", None, None, 2.5, None, None, 1.0, 0.0, "30_min_x", "custom", "1.0e-03", "", "1.23", None]
    assert S.resolve_freq("10min") == "10min" and S.resolve_freq(None, "NO_SUCH_VARIABLE") == "30min"


def test_labels_round_the_binary_value(spark):
    """2.85e-4 and 0.015 lie below their decimals, 0.125 is one: ties go to even, as C's printf and Python have it."""
    values = [0.000285, 0.00285, 0.0025, 0.00125, 0.015, 0.125, 0.375, 1.005, 2.675, -0.045, 0.0, -0.0, 5e-324, 1e300, 0.0099999, None, float("inf")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(S.annotation(F.col("v"))).collect()]
    plain = lambda v: "" if v is None or math.isinf(v) else f"{v:.1e}" if abs(v) < 0.01 and v else f"{v:.2f}"
    assert got == [plain(v) for v in values] and got[:2] == ["2.8e-04", "2.9e-03"] and got[4:6] == ["0.01", "0.12"]


def test_flags(spark):
    df = spark.createDataFrame([(1.0, "B7"), (2.0, " C "), (3.0, None), (4.0, "A6"), (float("nan"), "")], "v double, f string")
    assert sorted(r.v for r in drop_flagged(df.where("not isnan(v)"), "f").collect()) == [3.0, 4.0]
    assert [r.v for r in mask_flagged(df, {"v": "f"}).collect()] == [None, None, 3.0, 4.0, None]
    assert [r.v for r in mask_flagged(df, {"v": "absent"}).collect()][:2] == [1.0, 2.0]


def test_keep_first_and_numbering(spark):
    df = spark.createDataFrame([(1, "b", 2.0), (1, "a", 3.0), (2, "c", 1.0), (2, "c", 1.0)], "k int, f string, v double")
    assert sorted(map(tuple, keep_first(df, ["k"], ["f", "v"]).collect())) == [(1, "a", 3.0), (2, "c", 1.0)]
    random.seed(1)
    rows = [(i, T0 + dt.timedelta(seconds=random.randrange(40_000))) for i in range(500)]
    found = numbered(spark.createDataFrame(rows, "id long, ts timestamp_ntz").repartition(7), "ts", ["id"]).collect()
    assert [r.id for r in sorted(found, key=lambda r: r["_r"])] == [i for i, _ in sorted(rows, key=lambda x: (x[1], x[0]))]
    assert sorted(r["_r"] for r in found) == list(range(500))


def test_audit(spark):
    days = [dt.datetime(2020, 1, d, 5) for d in range(1, 31)] + [dt.datetime(2020, 3, 31, 0), dt.datetime(2020, 3, 31, 7)]
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "ts timestamp_ntz")
    rows = {r.year_month: r for r in calendar.month_audit(df, "ts", 0.9).collect()}
    assert list(rows) and set(rows) == {"2020-01", "2020-02", "2020-03"}
    assert rows["2020-01"].passes and rows["2020-02"].n_days_with_data == 0 and rows["2020-02"].n_days_required == 29 and not rows["2020-03"].passes
    late = spark.createDataFrame([(dt.datetime(2020, 3, 31, 7),)], "ts timestamp_ntz")
    assert calendar.month_audit(late, "ts", 0.9, midnight_end=True).first().n_days_with_data == 0
    assert calendar.keep_passing(df, "ts", calendar.month_audit(df, "ts", 0.9)).count() == 30
    assert calendar.month_audit(df.where("false"), "ts").count() == 0
    with pytest.raises(ValueError):
        calendar.month_audit(df, "ts", 0)


@pytest.mark.parametrize("width", [49, 48, 7])
def test_hampel_equals_pandas(spark, width):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 1, 400)
    v[::37] += 9
    v[50:60] = np.nan
    v[100:170] = 1.0
    x = pd.Series(v)
    least = max(3, width // 4)
    med = x.rolling(width, center=True, min_periods=least).median()
    mad = (x - med).abs().rolling(width, center=True, min_periods=least).median()
    want = ((x - med).abs() > 3 * 1.4826 * mad) & (mad > 1e-12)
    df = series(spark, [None if math.isnan(a) else float(a) for a in v])
    got = sorted(outliers.hampel(df, "ts", ["id"], "v", width, chunk_rows=64).collect(), key=lambda r: r.id)
    assert len(got) == 400 and [r.spike for r in got] == want.tolist()


def test_tukey(spark):
    df = series(spark, [1.0, 2.0, 3.0, 4.0, 100.0, None])
    assert [r.tukey_potential for r in sorted(outliers.global_tukey(df, "v").collect(), key=lambda r: r.id)] == [False] * 4 + [True, False]
    flat = outliers.fences(series(spark, [5.0] * 4), "v").first()
    assert (flat.inner_low, flat.inner_high) == (5.0, 5.0)
    golden = outliers.fences(spark.createDataFrame([(1.6,), (1.6,), (3.6,), (3.6,)], "v double"), "v").first()
    assert [round(golden[c], 6) for c in ("inner_low", "inner_high", "outer_low", "outer_high")] == [-1.4, 6.6, -4.4, 9.6]
    w = sorted(outliers.winsorised(df, "v").collect(), key=lambda r: r.id)
    assert w[4].winsorised == 7.0 and w[5].winsorised is None
    few = spark.createDataFrame([(dt.date(2020, 1, d), 1.0 if d < 9 else 99.0) for d in range(1, 10)], "day date, daily_median double")
    assert outliers.month_tukey(few).where("potential").count() == 0


def test_labels_of_a_series_without_values(spark):
    """No value is no reason to lose rows: there are no fences then, and nothing is flagged."""
    df = series(spark, [None] * 5).withColumn("v", F.col("v").cast("double"))
    rows = outliers.labelled(df, "ts", ["id"], "v", winsor=True).collect()
    assert sorted(r.id for r in rows) == list(range(5)) and not any(r.tukey_potential or r.tukey_possible or r.spike or r.conservative for r in rows)
    assert all(r.weight == 1.0 and r.winsorised is None for r in rows)
    assert tuple(percentiles(df, "v", (0.5,)).first()) == (0, [None], None, None)
    assert percentiles(df, "v", (0.5,), ["id"]).count() == 0 and windows.median_step(df.limit(1), "ts").count() == 0


@pytest.mark.parametrize("freq,agg", [("30min", "median"), ("7h", "mean")])
def test_resample_equals_pandas(spark, freq, agg):
    random.seed(4)
    times = sorted({T0 + dt.timedelta(minutes=random.choice((5, 10, 15)) * random.randrange(2000)) for _ in range(300)} | {T0 + dt.timedelta(minutes=30)})
    rows = [(t, random.choice([None, random.random()])) for t in times]
    want = getattr(pd.Series([math.nan if v is None else v for _, v in rows], index=pd.DatetimeIndex(times)).resample(freq, closed="right", label="right"), agg)()
    got = sorted(resample.resample(spark.createDataFrame(rows, "ts timestamp_ntz, v double"), "ts", ["v"], freq, agg).collect(), key=lambda r: r.bin)
    assert [r.bin for r in got] == [t.to_pydatetime() for t in want.index]
    assert sum(r.n_obs_v for r in got) == sum(v is not None for _, v in rows)
    for r, v in zip(got, want, strict=True):
        assert (r.v is None) == math.isnan(v) and (r.v is None or abs(r.v - v) < 1e-9)
    assert resample.resample(spark.createDataFrame([], "ts timestamp_ntz, v double"), "ts", ["v"], freq, agg).count() == 0
    with pytest.raises(ValueError):
        resample.resample(series(spark, [1.0]), "ts", ["v"], freq, "max")


def test_splits_and_scaler(spark):
    df = splits.split(series(spark, [1.0, 2.0, 3.0, None, 5.0], 86400), "ts", "2024-01-03", "2024-01-05")
    assert [r.split for r in df.orderBy("id").collect()] == ["train", "train", "val", "val", "test"]
    scaler = splits.fit_scaler(df.where("split = 'train'"), ["v"])
    assert scaler.first()["scaler"]["v"].asDict() == {"n": 2, "mean": 1.5, "std": 0.5}
    z = splits.apply_scaler(df, scaler, ["v"])
    back = splits.apply_scaler(z.drop("v"), scaler, ["v"], inverse=True)
    assert [r.v for r in back.orderBy("id").collect()] == [1.0, 2.0, 3.0, None, 5.0]
    assert splits.fit_scaler(series(spark, [4.0, 4.0]), ["v"]).first()["scaler"]["v"]["std"] == 1.0
    with pytest.raises(Exception, match="no finite value"):
        splits.fit_scaler(series(spark, [None]), ["v"]).collect()
    with pytest.raises(ValueError):
        splits.split(df, "ts", "2024-02-01", "2024-01-01")


def test_statistics(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 9, 200).astype(float), rng.normal(size=200)
    x[::11], y[::7] = np.nan, np.nan
    pdf = pd.DataFrame({"x": x, "y/z": y})
    df = spark.createDataFrame([(None if math.isnan(a) else float(a), None if math.isnan(b) else float(b)) for a, b in zip(x, y, strict=True)], "x double, `y/z` double")
    assert abs(stats.pearson(df, ["x", "y/z"]).first().r - pdf.corr().iloc[0, 1]) < 1e-9
    assert abs(stats.spearman(df, ["x", "y/z"]).first().r - pdf.dropna().rank().corr().iloc[0, 1]) < 1e-9
    assert {r.column: r.missing for r in stats.missing_rates(df, ["x", "y/z"]).collect()} == pytest.approx({"x": np.isnan(x).mean(), "y/z": np.isnan(y).mean()})
    assert stats.missing_rates(df.where("false"), ["x"]).first().missing == 1.0
    assert list(stats.complete_cases(df, ["x", "y/z"]).first()) == [200, len(pdf.dropna())]
    h = stats.histogram(df, "x", 8).collect()
    assert sum(r.n for r in h) == np.isfinite(x).sum() and len(h) == 8
    assert [r.n for r in sorted(h, key=lambda r: r.bucket)] == np.histogram(x[np.isfinite(x)], 8)[0].tolist()
    d = {r.column: r for r in stats.describe(df, ["x"]).collect()}["x"]
    assert d.std == pytest.approx(pdf["x"].std()) and d.q25 == pytest.approx(pdf["x"].quantile(0.25))


def brute_windows(v, s):
    n, out = len(v), {}
    for i in range(0, n - s.context - s.shift - s.future + 1, s.stride):
        e = i + s.context - 1
        fut = v[e + s.shift + 1 : e + s.shift + s.future + 1]
        if not s.skip_null_target or fut[0] is not None:
            out[i] = (v[i : e + 1], fut)
    return out


@pytest.mark.parametrize("s", [windows.WindowSettings(6, 0, 4, 3), windows.WindowSettings(1, 2, 1, 1, False), windows.WindowSettings(5, 1, 3, 2, True, None)])
def test_windows_equal_brute_force(spark, s):
    random.seed(6)
    v = [random.choice([None, random.random(), random.random()]) for _ in range(61)]
    got = windows.sliding(series(spark, v), "ts", ["v"], "v", s, keys=(), tie=("id",), chunk_rows=16).collect()
    want = brute_windows(v, s)
    assert {r.window_id: ([c.y for c in r.context], [f.y for f in r.future]) for r in got} == want and len(got) == len(want)
    assert all(f.w == 1.0 for r in got for f in r.future)


def test_window_edges(spark):
    s = windows.WindowSettings(4, 1, 2, 1)
    assert windows.sliding(series(spark, [1.0] * 7), "ts", ["v"], "v", s, keys=()).count() == 1
    with pytest.raises(ValueError):
        windows.require_windows(windows.sliding(series(spark, [1.0] * 6), "ts", ["v"], "v", s, keys=()))
    with pytest.raises(ValueError):
        windows.WindowSettings(future=0)
    gappy = series(spark, [1.0] * 20).withColumn("ts", F.expr("if(id >= 10, timestampadd(HOUR, 9, ts), ts)"))
    found = {r.window_id for r in windows.sliding(gappy, "ts", ["v"], "v", s, keys=()).collect()}
    assert found == {i for i in range(14) if i + 6 < 10 or i >= 10}
    weights = series(spark, [1.0] * 7).withColumn("weight", F.when(F.col("id") != 5, F.lit(7.0)))
    assert [f.w for f in windows.sliding(weights, "ts", ["v"], "v", s, keys=()).first().future] == [0.0, 1.0]
    arr = spark.createDataFrame([([1.0, None, 3.0, 4.0],)], "a array<double>").select(windows.folded(F.col("a"), 2).alias("p"))
    assert arr.select("p", windows.patch_valid(F.col("p"))).first()[:] == ([[1.0, None], [3.0, 4.0]], [True, True])


def long(spark, rows):
    return spark.createDataFrame(rows, "window_id long, step int, y double, y_hat double, valid boolean, w double, end_value double")


def test_calibration_equals_loop(spark):
    random.seed(7)
    rows, want = [], {}
    for wid in range(4):
        bias, total, weight = 0.0, 0.0, 0.0
        for step in range(22):
            if step % 5 == 0 and step:
                bias, total, weight = (bias + total / weight if weight > 1e-12 else bias), 0.0, 0.0
            y, p, ok, w = random.random(), random.random(), random.random() < 0.7 and not 5 <= step < 10, random.choice([0.0, 0.5, 1.0])
            want[wid, step] = p + bias
            if ok and w > 0:
                total, weight = total + w * (y - p - bias), weight + w
            rows.append((wid, step, y, p, ok, w, 0.0))
    got = calibration.calibrated(long(spark, rows), 5).collect()
    assert {(r.window_id, r.step): r.y_cal for r in got} == pytest.approx(want)
    assert all(abs(r.y_cal - r.y_hat) < 1e-12 for r in got if r.block == 0)
    assert calibration.first_blocks(long(spark, rows), 5, 3).count() == 3
    with pytest.raises(ValueError):
        calibration.block_bias(long(spark, rows), 0)


def test_metrics(spark):
    rows = [(0, 0, 1.0, 2.0, True, 1.0, 0.5), (0, 1, 2.0, 2.5, True, 0.0, 0.5), (1, 0, None, 1.0, False, 1.0, 1.0), (1, 1, 4.0, float("nan"), True, 1.0, 1.0), (1, 2, 5.0, 3.0, True, 2.0, 1.0)]
    df = long(spark, rows)
    assert metrics.errors(df).first()[:] == pytest.approx((math.sqrt((1 + 0.25 + 4) / 3), 3.5 / 3, 3))
    assert metrics.weighted_errors(df).first()[:] == pytest.approx((math.sqrt((1 + 8) / 3), 5 / 3, 1.0, 2))
    none = metrics.weighted_errors(df.withColumn("w", F.lit(0.0))).first()
    assert none[:] == (None, None, 0.0, 0) and metrics.errors(df.where("false")).first().rmse is None
    assert {r.step: r.n for r in metrics.per_step(df).collect()} == {0: 1, 1: 1, 2: 1}
    assert {r.block: r.n for r in metrics.per_block(df, 2).collect()} == {0: 2, 1: 1}
    assert [r.window_id for r in metrics.top_windows(df, 1).collect()] == [0]
    assert metrics.weighted_mse(df).first().loss == pytest.approx((1 * 1 + 2 * 4) / 3)
    with pytest.raises(Exception, match="no valid training target"):
        metrics.mean_baseline(df.where("false"), df).collect()
    with pytest.raises(Exception, match="no valid target with an end value"):
        metrics.persistence_baseline(df.withColumn("end_value", F.lit(None).cast("double")), require=True).collect()
    assert metrics.persistence_baseline(df, require=True).count() == 5
    two = long(spark, [(0, 0, 1.0, 2.0, True, 1.0, 0.0), (0, 1, 3.0, 1.0, True, 1.0, 0.0)])
    # level ((1)^2 + (-2)^2) / 2; differences 1, 2 against 2, -1
    assert metrics.tdalign(two).first()[:] == pytest.approx((2.5, (1 + 9) / 2, 0.5, 0.5 * 2.5 + 0.5 * 5))
    assert metrics.tdalign(two, loss="mae").first().level == pytest.approx(1.5)
    hole = long(spark, [(0, 0, None, 2.0, False, 1.0, 0.0), (0, 1, 3.0, 1.0, True, 1.0, 0.0)])
    assert metrics.tdalign(hole, need_previous=False).first().difference is None
    d = metrics.distillation(two, two.withColumn("y_hat", F.col("y")), 0.25).first()
    assert d.supervised == pytest.approx(2.5) and d.loss == pytest.approx(2.5)


def test_spans(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    df = spark.createDataFrame([(at(0), "M"), (at(60), "M"), (at(121), "M"), (at(5), "C "), (at(7), "")], "ts timestamp_ntz, f string")
    got = sorted((r.flag, r.first, r.last, r.n) for r in spans.flag_spans(df, "ts", "f").collect())
    assert got == [("C", at(5), at(5), 1), ("M", at(0), at(60), 2), ("M", at(121), at(121), 1)]
    assert {r.flag for r in spans.distinct_flags(df, "ts", "f", 2024).collect()} == {"M", "C"}


def test_models(spark):
    rng = np.random.default_rng(8)
    c = models.ForecastConfig(channels=2, horizon=3, hidden=8, layers=2, patch=4, heads=2)
    x, ok = rng.normal(size=(5, 8, 2)), rng.random((5, 8, 2)) < 0.8
    ok[0] = False
    y = rng.normal(size=(5, 8))
    assert models.gru(models.gru_weights(c), x, ok, c).shape == (5, 3)
    t = models.attention(models.attention_weights(c), x, ok, c, y, np.ones_like(y, bool))
    assert t.shape == (5, 3) and np.isfinite(t).all()
    for shared in (False, True):
        assert np.isfinite(models.attention(models.attention_weights(c, True, shared), x, ok, c)).all()
    # what is not valid does not matter
    assert np.allclose(models.gru(models.gru_weights(c), np.where(ok, x, 99.0), ok, c), models.gru(models.gru_weights(c), x, ok, c))
    with pytest.raises(ValueError):
        models.fold(x, ok, 3)
    df = series(spark, [float(i % 5) for i in range(40)])
    w = windows.sliding(df.withColumn("u", F.col("v") * 2), "ts", ["v", "u"], "v", windows.WindowSettings(8, 0, 3, 1), keys=())
    got = models.predict(w, "gru", models.gru_weights(c), c, keys=())
    assert got.count() == w.count() * 3 and got.where("y_hat is null").count() == 0
    ridge = models.fit_ridge(w, c)
    assert ridge["w"].shape == (4, 3)
    stop = models.EarlyStopping(2, 0.1)
    assert [stop.step(i, m) for i, m in enumerate([5.0, 4.0, 3.95, float("nan")])] == [False, False, False, True] and stop.best_epoch == 1


def test_student_estimates_the_end_value(spark):
    rng = np.random.default_rng(9)
    c = models.ForecastConfig(channels=2, horizon=3, hidden=8, layers=2, patch=4, heads=2, kv_layers=1)
    x, ok = rng.normal(size=(5, 8, 2)), rng.random((5, 8, 2)) < 0.8
    for shared in (False, True):
        p = models.attention_weights(c, True, shared, residual=True)
        y, end, delta = models.attention_residual(p, x, ok, c)
        assert y.shape == delta.shape == (5, 3) and end.shape == (5,) and np.allclose(y, end[:, None] + delta) and end.std() > 0
    df = series(spark, [float(i % 5) for i in range(40)])
    w = windows.sliding(df.withColumn("u", F.col("v") * 2), "ts", ["v", "u"], "v", windows.WindowSettings(8, 0, 3, 1), keys=())
    got = models.predict(w, "student_residual", p, c, keys=())
    assert got.columns == ["window_id", "step", "y_hat", "end_hat", "delta"] and got.count() == w.count() * 3
    assert got.where("y_hat is null or abs(y_hat - end_hat - delta) > 1e-9").count() == 0
    # the observed end value does not matter
    other = models.predict(w.withColumn("end_value", F.col("end_value") + 7), "student_residual", p, c, keys=())
    assert sorted(map(tuple, other.collect())) == sorted(map(tuple, got.collect()))
    with pytest.raises(ValueError):
        models.predict(w, "student", p, c, residual=True, keys=())


def test_mlp_has_two_hidden_layers():
    c = models.ForecastConfig(channels=1, horizon=1, hidden=2)
    p = {"head1.w": np.array([[1.0, 0], [0, 1]]), "head1.b": np.zeros(2), "head2.w": np.array([[1.0, -1], [-1, 1]]), "head2.b": np.array([0.0, 0.5]), "head3.w": np.array([[2.0, 3.0]]), "head3.b": np.array([1.0])}
    x = np.array([[[3.0], [1.0]], [[-1.0], [2.0]]])
    assert models.mlp(p, x, np.ones_like(x, bool), c).tolist() == [[5.0], [8.5]]
    assert set(models.mlp_weights(c, 2)) == set(p)
