"""Streams with keyed state against the batch operators, batch by batch and after a restart."""

import datetime as dt
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from weirflow.operators import calibration
from weirflow.operators.resample import resample
from weirflow.streaming.calibration import calibrated_stream
from weirflow.streaming.panel import dense_panel, stream_panel

T0 = dt.datetime(2024, 1, 1, 5, 10)


class Feed:
    """A folder of files, one for each batch, and a query over it that can be stopped and started again."""

    def __init__(self, spark, root, schema, build):
        self.spark, self.root, self.schema, self.build, self.n = spark, root, schema, build, 0
        os.makedirs(f"{root}/in")
        self.query = None

    def start(self):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.root}/in")
        self.query = self.build(stream).writeStream.format("parquet").option("path", f"{self.root}/out").option("checkpointLocation", f"{self.root}/check").outputMode("append").start()

    def stop(self):
        self.query.stop()

    def add(self, rows):
        part = f"{self.root}/part{self.n}"
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(part)
        file = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        os.utime(f"{part}/{file}", (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        os.rename(f"{part}/{file}", f"{self.root}/in/{self.n:04d}.parquet")
        self.n += 1
        self.query.processAllAvailable()

    def out(self):
        return self.spark.read.parquet(f"{self.root}/out").collect()


@pytest.fixture
def session(spark):
    """A session of its own, as streams set its state store."""
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "2")
    return own


SCHEMA = "window_id long, step int, ts timestamp, y double, y_hat double, valid boolean, w double"


def forecast(rng, windows, steps):
    rows = []
    for wid in range(windows):
        for step in range(steps):
            hole = wid == 1 and 6 <= step < 12
            rows.append((wid, step, T0 + dt.timedelta(minutes=30 * (step + 3 * wid)), None if rng.random() < 0.1 else rng.random(), rng.random(), not hole and rng.random() < 0.9, rng.choice([0.0, 0.5, 1.0])))
    return rows


def test_calibration_of_a_stream(session, tmp_path):
    rng = random.Random(3)
    rows = forecast(rng, 3, 40)
    rows.sort(key=lambda r: r[2])
    batches = [rows[i : i + 17] for i in range(0, len(rows), 17)]
    for a, b in zip(batches, batches[1:], strict=False):  # neighbours are mixed: rows come late, but within the delay
        k = rng.randrange(4)
        a[len(a) - k :], b[:k] = b[:k], a[len(a) - k :]
        rng.shuffle(a)
    feed = Feed(session, str(tmp_path), SCHEMA, lambda s: calibrated_stream(s, 6, late="12 hours"))
    seen = []
    feed.start()
    for i, batch in enumerate(batches):
        feed.add(batch)
        seen += batch
        if i in (1, 4):  # state comes back from the checkpoint
            feed.stop()
            feed.start()
        got = {(r.window_id, r.step): r.y_cal for r in feed.out()}
        want = {(r.window_id, r.step): r.y_cal for r in calibration.calibrated(session.createDataFrame(seen, SCHEMA), 6).collect()}
        limit = max(r[2] for r in seen) - dt.timedelta(hours=12)
        starts = {(w, s // 6): min(r[2] for r in rows if r[0] == w and r[1] // 6 == s // 6) for w, s, *_ in rows}
        ready = {(w, s) for w, s, *_ in seen if starts[w, s // 6] <= limit}
        assert set(got) == ready, i
        assert all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in got)
    assert len(got) > 30
    # Rows of another window, far ahead, close all: the report is that of the batch.
    feed.add([(99, 0, T0 + dt.timedelta(days=9), None, 0.5, False, 0.0)])
    feed.stop()
    final = session.read.parquet(f"{tmp_path}/out").where("window_id < 99")
    assert final.count() == len(rows)
    from weirflow.operators.metrics import weighted_errors

    batch = {r.kind: r for r in calibration.calibration_report(session.createDataFrame(rows, SCHEMA), 6).collect()}
    for kind, column in (("raw", "y_hat"), ("calibrated", "y_cal")):
        r = weighted_errors(final.withColumn("y_hat", F.col(column))).first()
        assert (r.rmse, r.mae, r.bias, r.n) == pytest.approx((batch[kind].rmse, batch[kind].mae, batch[kind].bias, batch[kind].n))


PANEL = "g string, ts timestamp, v double, u double"


def readings(rng, n):
    rows, at = [], T0
    for _ in range(n):
        at += dt.timedelta(minutes=rng.choice([0, 3, 10, 10, 200]))
        rows.append((rng.choice(["a", "b", None]), at, rng.choice([None, round(rng.random(), 1), 7.0]), rng.random()))
    return rows


@pytest.mark.parametrize("agg", ["median", "mean"])
def test_dense_panel_of_a_stream(session, tmp_path, agg):
    rng = random.Random(7)
    rows = readings(rng, 160)
    batches = [rows[i : i + 20] for i in range(0, len(rows), 20)]
    for a, b in zip(batches, batches[1:], strict=False):
        a[-2:], b[:2] = b[:2], a[-2:]
    feed = Feed(session, str(tmp_path), PANEL, lambda s: dense_panel(s, "ts", ["v", "u"], "30min", "10 hours", agg, keys=["g"]))
    feed.start()
    seen = []
    plain = lambda r: (r.g, r.bin, None if r.v is None else round(r.v, 9), None if r.u is None else round(r.u, 9), r.n_obs_v, r.n_obs_u)
    for i, batch in enumerate(batches):
        feed.add(batch)
        seen += batch
        if i == 3:
            feed.stop()
            feed.start()
        limit = max(r[1] for r in seen) - dt.timedelta(hours=10)
        got = {plain(r) for r in feed.out()}
        every = resample(session.createDataFrame(seen, PANEL).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", ["v", "u"], "30min", agg, keys=["g"]).collect()
        filled = {(r.g, r.bin) for r in every if r.n_obs_v + r.n_obs_u}
        closed = {g: max((b for h, b in filled if h == g and b <= limit), default=None) for g in ("a", "b", None)}
        assert got == {plain(r) for r in every if closed[r.g] is not None and r.bin <= closed[r.g]}, i
    feed.stop()
    assert len(got) > 60 and any(r[4] == 0 for r in got)


def test_empty_bins_of_a_series_that_rests(session, tmp_path):
    """Timers emit what the watermark has passed, before the series goes on."""
    feed = Feed(session, str(tmp_path), PANEL, lambda s: dense_panel(s, "ts", ["v"], "1h", "1 hour", keys=["g"], ahead=True))
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    feed.start()
    feed.add([("a", at(0.5), 1.0, 0.0), ("a", at(0.7), 2.0, 0.0), ("b", at(0.5), 5.0, 0.0)])
    feed.add([("b", at(5.5), 6.0, 0.0)])
    feed.add([("b", at(8.5), 6.0, 0.0)])
    got = sorted((r.g, r.bin, r.v, r.n_obs_v) for r in feed.out())
    a = [r for r in got if r[0] == "a"]
    assert a[0] == ("a", at(1), 1.5, 2) and len(a) >= 4 and all(r[2:] == (None, 0) for r in a[1:])
    assert [r[1] for r in a] == [at(1 + k) for k in range(len(a))]
    feed.add([("a", at(20.5), 9.0, 0.0)])
    feed.add([("b", at(40.5), 9.0, 0.0)])
    feed.stop()
    rows = sorted((r.g, r.bin, r.v) for r in feed.out())
    for g in ("a", "b"):
        bins = [r[1] for r in rows if r[0] == g]
        assert bins == [bins[0] + dt.timedelta(hours=k) for k in range(len(bins))]  # every bin once
    assert ("a", at(21), 9.0) in rows and ("b", at(6), 6.0) in rows


def test_median_bins_of_a_stream_without_keys(session, tmp_path):
    rng = random.Random(2)
    rows = readings(rng, 60)
    feed = Feed(session, str(tmp_path), PANEL, lambda s: stream_panel(s, "ts", ["v"], "1 hour", "1 hour", "median"))
    feed.start()
    feed.add(rows)
    feed.add([(None, rows[-1][1] + dt.timedelta(hours=9), None, None)])
    feed.stop()
    got = {r.bin.replace(tzinfo=None): (r.v, r.n_obs_v) for r in feed.out()}
    want = {r.bin: (r.v, r.n_obs_v) for r in resample(session.createDataFrame(rows, PANEL).withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts", ["v"], "1h").collect()}
    assert {b: want[b] for b in got} == got and len(got) > 15
