"""Moving medians, windows cut from chunks, and keys that are NULL."""

import datetime as dt
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weirflow.operators import ordering, outliers, rolling, stats, windows

T0 = dt.datetime(2024, 1, 1)


def series(spark, values, step=10, **more):
    rows = [(i, T0 + dt.timedelta(seconds=step * i), None if v is None or v != v else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, ts timestamp_ntz, v double").withColumns({k: F.lit(x) for k, x in more.items()})


def test_order_statistics_of_ranges():
    rng = np.random.default_rng(1)
    for n, distinct in ((1, 1), (50, 3), (333, 1000)):
        v = rng.integers(0, distinct, n).astype(float)
        lo = rng.integers(0, n, 200)
        hi = lo + 1 + rng.integers(0, n, 200) % (n - lo)
        k = rng.integers(0, n, 200) % (hi - lo)
        assert rolling.order_statistics(v, lo, hi, k).tolist() == [sorted(v[a:b])[i] for a, b, i in zip(lo, hi, k, strict=True)]


@pytest.mark.parametrize("width", [1, 2, 7, 48, 49, 500, 2000])
def test_moving_median_equals_pandas(width):
    rng = np.random.default_rng(width)
    v = rng.normal(0, 1, 700).round(1)
    v[rng.random(700) < 0.3] = np.nan
    v[200:300] = np.nan
    after, least = (width - 1) // 2, max(3, width // 4)
    got, known = rolling.moving_median(np.nan_to_num(v), ~np.isnan(v), width - 1 - after, after, least)
    padded = pd.Series(np.concatenate([np.full(width, np.nan), v, np.full(width, np.nan)]))
    want = padded.rolling(width, min_periods=1).median().to_numpy()[width + after : width + after + 700]
    count = padded.notna().rolling(width).sum().to_numpy()[width + after : width + after + 700]
    assert known.tolist() == (count >= least).tolist()
    assert np.allclose(got[known], want[known])


@pytest.mark.parametrize("width", [8641, 8640])
def test_hampel_of_a_day_at_ten_seconds(spark, width):
    """Wide frames over several chunks, with gaps, ties and an even width."""
    rng = np.random.default_rng(5)
    v = np.sin(np.arange(30_000) / 900) + rng.normal(0, 0.05, 30_000).round(2)
    v[rng.integers(0, 30_000, 300)] += 4
    v[rng.random(30_000) < 0.1] = np.nan
    v[12_000:20_000] = np.nan
    x, least = pd.Series(v), max(3, width // 4)
    med = x.rolling(width, center=True, min_periods=least).median()
    mad = (x - med).abs().rolling(width, center=True, min_periods=least).median()
    want = ((x - med).abs() > 3 * 1.4826 * mad) & (mad > 1e-12)
    rows = series(spark, v).repartition(3)
    got = outliers.hampel(rows, "ts", ["id"], "v", width, chunk_rows=1000).orderBy("id").toPandas()
    assert got.spike.tolist() == want.tolist() and want.sum() > 100
    if width % 2:  # an even frame has its extra row on another side there
        assert np.allclose(got.rolling_median.astype(float), med, equal_nan=True)


def test_moving_medians_cost_the_same_at_any_width():
    v = np.random.default_rng(2).normal(0, 1, 60_000)
    there = np.ones(len(v), bool)
    took = {}
    for width in (49, 8641):
        start = time.process_time()
        for _ in range(3):
            rolling.moving_median(v, there, width // 2, width // 2, 3)
        took[width] = time.process_time() - start
    assert took[8641] < 3 * took[49] + 0.2


def brute(v, s):
    n, out = len(v), {}
    for i in range(0, n - s.context - s.shift - s.future + 1, s.stride):
        e = i + s.context - 1
        fut = v[e + s.shift + 1 : e + s.shift + s.future + 1]
        if not s.skip_null_target or fut[0] is not None:
            out[i] = (v[i : e + 1], fut)
    return out


SETTINGS = [windows.WindowSettings(6, 0, 4, 48), windows.WindowSettings(6, 0, 4, 10, False), windows.WindowSettings(3, 2, 2, 7), windows.WindowSettings(20, 0, 30, 1), windows.WindowSettings(20, 3, 30, 9, True, None), windows.WindowSettings(1, 0, 1, 5)]


@pytest.mark.parametrize("s", SETTINGS)
@pytest.mark.parametrize("chunk,cut", [(16, 30), (2048, 1 << 17)])
def test_windows_of_any_stride(spark, s, chunk, cut, monkeypatch):
    monkeypatch.setattr(windows, "CUT_ROWS", cut)
    rng = random.Random(6)
    v = [rng.choice([None, rng.random(), rng.random()]) for _ in range(211)]
    got = windows.sliding(series(spark, v), "ts", ["v"], "v", s, keys=(), tie=("id",), chunk_rows=chunk).collect()
    assert {r.window_id: ([c.y for c in r.context], [f.y for f in r.future]) for r in got} == brute(v, s)
    at = lambda i: T0 + dt.timedelta(seconds=10 * i)
    assert all(r.context_end == at(r.window_id + s.context - 1) and r.end_value == r.context[-1].y for r in got)
    assert all([f.ts for f in r.future] == [at(r.window_id + s.context + s.shift + k) for k in range(s.future)] for r in got)


def test_work_falls_with_the_stride(spark):
    """Rows that no window holds are not gathered, the others once for each chunk."""
    df = series(spark, range(4000))
    rows = lambda stride: windows.sliding(df, "ts", ["v"], "v", windows.WindowSettings(4, 0, 4, stride), keys=(), tie=("id",))
    assert rows(100).count() == 40 and rows(1).count() == 4000 - 7
    text = rows(100)._jdf.queryExecution().optimizedPlan().toString()
    assert "% 100" in text.replace("cast(100 as bigint)", "100")


def test_null_is_a_key(spark):
    rng = random.Random(3)
    rows = [(i, T0 + dt.timedelta(minutes=i // 2), rng.choice([None, rng.random(), 2.0]), None if i % 2 else "a") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, v double, g string")
    own = {g: [r for r in rows if r[3] == g] for g in ("a", None)}

    numbered = {(r.g, r._r): r.id for r in ordering.numbered(df, "ts", ["id"], ["g"]).collect()}
    assert numbered == {(g, k): r[0] for g, rs in own.items() for k, r in enumerate(rs)}

    pdf = pd.DataFrame(rows, columns=["id", "ts", "v", "g"]).astype({"v": float})
    found = {r.g: r for r in stats.describe(df, ["v"], ["g"]).collect()}
    for g, rs in own.items():
        want = pd.Series([r[2] for r in rs], dtype=float).describe()
        assert [found[g][k] for k in ("n", "mean", "std", "min", "q25", "q50", "q75", "max")] == pytest.approx(want.tolist())
    assert len(found) == 2 and len(pdf) == 120

    fences = {r.g: r for r in outliers.fences(df, "v", ["g"]).collect()}
    for g in own:
        alone = outliers.fences(df.where(F.col("g").eqNullSafe(F.lit(g))), "v").first()
        assert [fences[g][k] for k in ("n", "inner_low", "outer_high")] == [alone[k] for k in ("n", "inner_low", "outer_high")]

    s = windows.WindowSettings(5, 0, 3, 2)
    got = windows.sliding(df, "ts", ["v"], "v", s, keys=("g",), tie=("id",)).collect()
    for g, rs in own.items():
        want = brute([r[2] for r in rs], s)
        assert {r.window_id: ([c.y for c in r.context], [f.y for f in r.future]) for r in got if r.g == g} == want
    assert {r.g: r.step for r in windows.median_step(df, "ts", ["id"], ["g"]).collect()} == {"a": 60_000_000, None: 60_000_000}

    ranks = {(r.g, r.v): r.k for r in stats.average_ranks(df.where("v is not null"), "v", ["g"], "k").collect()}
    for g, rs in own.items():
        v = pd.Series([r[2] for r in rs if r[2] is not None])
        assert all(ranks[g, x] == k for x, k in zip(v, v.rank(), strict=True))


@pytest.mark.parametrize("holes", [0.0, 0.3])
def test_spearman_equals_pandas(spark, holes):
    """Pairs with different missing rows, ties, repeated rows, a column that does not vary, and names with dots."""
    rng = np.random.default_rng(11)
    n = 400
    v = rng.normal(0, 1, (n, 6))
    v[:, 1] = v[:, 0] * 0.7 + v[:, 1]
    v[:, 2] = v[:, 2].round(0)
    v[:, 5] = 3.0
    v[rng.random((n, 6)) < holes] = np.nan
    v[100:150] = v[50:100]
    pdf = pd.DataFrame(v, columns=["a", "b.c", "d/e", "f", "g", "same"])
    df = spark.createDataFrame([tuple(None if x != x else float(x) for x in r) for r in v], "a double, `b.c` double, `d/e` double, f double, g double, same double").repartition(3)
    want = pdf.corr("spearman")
    got = {(r.a, r.b): r.r for r in stats.spearman(df, list(pdf.columns), buckets=5).collect()}
    assert len(got) == 15
    for (a, b), r in got.items():
        if "same" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-12)
    assert all(r.r is None for r in stats.spearman(df.where("false"), ["a", "f"]).collect())


def test_spearman_keeps_ties_out_of_one_task(spark, monkeypatch):
    """Rows of one value are not brought together, in Python least of all; common and rare values give the same ranks."""
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"few": rng.integers(0, 3, 2000).astype(float), "some": rng.integers(0, 700, 2000).astype(float), "all": rng.normal(0, 1, 2000)})
    pdf.loc[rng.random(2000) < 0.2, "some"] = np.nan
    df = spark.createDataFrame([tuple(None if x != x else float(x) for x in r) for r in pdf.itertuples(index=False)], "few double, some double, all double").repartition(3)
    want = pdf.corr("spearman")
    for common in (2, 100, 10**6):  # no value, some and all of them common
        monkeypatch.setattr(stats, "COMMON", common)
        found = stats.spearman(df, list(pdf.columns), buckets=7)
        assert "InArrow" not in found._jdf.queryExecution().toString()
        got = {(r.a, r.b): r.r for r in found.collect()}
        assert len(got) == 3 and all(r == pytest.approx(want.loc[k], abs=1e-12) for k, r in got.items())
