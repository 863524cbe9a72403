"""NPZ files as tables: NumPy's own files in, Spark's files out, and windows through both."""

import datetime as dt
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.operators import windows
from weirflow.sources import npz

T0 = dt.datetime(2024, 1, 1)


def arrays(n, rng):
    x = rng.normal(0, 1, (n, 4, 3)).astype(np.float32)
    x[rng.random(x.shape) < 0.2] = np.nan
    times = np.datetime64("2024-01-01T00:00:00", "ns") + np.arange(n).astype("timedelta64[m]")
    times[n // 2] = np.datetime64("NaT")
    return {"X_z": x, "X_mask": np.isfinite(x), "y": rng.normal(0, 1, n), "k": np.arange(n, dtype=np.int32), "at": times, "name": np.array([f"row{i}" for i in range(n)])}


def none(v):
    return None if v != v else float(v)


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
@pytest.mark.parametrize("size", [64 << 20, 500])
def test_files_of_numpy(spark, tmp_path, save, size):
    rng = np.random.default_rng(1)
    first, second = arrays(40, rng), arrays(7, rng)
    save(tmp_path / "a.npz", **first)
    save(tmp_path / "b.npz", **second)
    rows = npz.read(spark, str(tmp_path), place=True, range_bytes=size)
    assert dict(rows.dtypes) == {"X_z": "array<array<float>>", "X_mask": "array<array<boolean>>", "y": "double", "k": "bigint", "at": "timestamp_ntz", "name": "string", "npz_file": "string", "npz_row": "bigint"}
    got = rows.orderBy("npz_file", "npz_row").collect()
    assert [(r.npz_file, r.npz_row) for r in got] == [("a.npz", i) for i in range(40)] + [("b.npz", i) for i in range(7)]
    for r in got:
        own = first if r.npz_file == "a.npz" else second
        i = r.npz_row
        assert r.X_z == [[none(v) for v in row] for row in own["X_z"][i]] and r.X_mask == own["X_mask"][i].tolist()
        assert (r.y, r.k, r.name) == (own["y"][i], own["k"][i], own["name"][i])
        assert r.at == (None if np.isnat(own["at"][i]) else own["at"][i].astype("datetime64[us]").item())
    if size == 500 and save is np.savez:
        assert rows.rdd.getNumPartitions() > 5
    some = npz.read(spark, str(tmp_path / "a*.npz"), ["k"])
    assert some.columns == ["k"] and some.agg(F.sum("k")).first()[0] == sum(range(40))


def test_ranges_read_their_own_rows_alone(tmp_path):
    """A reader of stored arrays seeks: the bytes that it reads are those of its rows, and the headers."""
    n = 20_000
    np.savez(tmp_path / "big.npz", x=np.arange(n * 50, dtype=np.float64).reshape(n, 50))
    size = os.path.getsize(tmp_path / "big.npz")
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, k=-1):
            data = self.f.read(k)
            read.append(len(data))
            return data

        def __getattr__(self, name):
            return getattr(self.f, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

    class System:
        def open_input_file(self, at):
            return Counted(open(at, "rb"))

    original = npz.file_system
    reader = npz.NpzReader(str(tmp_path / "big.npz"), None, 1 << 20, False)
    parts = reader.partitions()
    assert len(parts) == -(-size // (1 << 20)) and parts[-1].stop == n
    try:
        npz.file_system = lambda path: (System(), path)
        rows = sum(b.num_rows for b in reader.read(parts[3]))
    finally:
        npz.file_system = original
    assert rows == parts[3].stop - parts[3].start and sum(read) < (1 << 20) + 100_000


def test_what_is_refused(spark, tmp_path):
    np.savez(tmp_path / "uneven.npz", a=np.zeros(3), b=np.zeros(4))
    np.savez(tmp_path / "scalar.npz", a=np.float64(3))
    np.savez(tmp_path / "none.npz", a=np.zeros((0, 3)))
    for name, why in (("uneven", "differ in length"), ("scalar", "rank 1"), ("absent", "nothing matches")):
        with pytest.raises(Exception, match=why):
            npz.read(spark, str(tmp_path / f"{name}.npz")).collect()
    with pytest.raises(Exception, match="no arrays"):
        npz.read(spark, str(tmp_path / "uneven.npz"), ["c"]).collect()
    empty = npz.read(spark, str(tmp_path / "none.npz"))
    assert empty.count() == 0 and empty.dtypes == [("a", "array<double>")]
    rows = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "a array<double>").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        npz.write(rows, str(tmp_path / "bad"))
    assert not [f for f in os.listdir(tmp_path / "bad") if f.endswith(".npz") or f.startswith("_")]


@pytest.mark.parametrize("compressed", [False, True])
def test_windows_through_files(spark, tmp_path, compressed):
    rng = random.Random(4)
    rows = [(T0 + dt.timedelta(minutes=30 * i), rng.choice([None, rng.random()]), rng.random(), rng.choice([None, rng.random(), rng.random()]), rng.random()) for i in range(90)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, a double, b double, y double, weight double")
    found = windows.sliding(df, "ts", ["a", "b"], "y", windows.WindowSettings(6, 1, 4, 2, False), keys=())
    out = str(tmp_path / "w")
    npz.write(windows.arrays_of(found).repartition(3), out, compressed, {"upstream": "panel"}, file_bytes=2000)
    files = sorted(f for f in os.listdir(out) if f.endswith(".npz"))
    about = json.load(open(f"{out}/manifest.json"))
    assert about["upstream"] == "panel" and about["n_samples"] == found.count() and [f["name"] for f in about["files"]] == files and len(files) > 3
    with np.load(f"{out}/{files[0]}", allow_pickle=False) as z:  # what NumPy sees
        n = about["files"][0]["rows"]
        assert z["X_z"].shape == (n, 6, 2) and z["X6_z"].shape == (n, 6, 3) and z["Y_z"].shape == z["target_times"].shape == (n, 4)
        assert z["X_z"].dtype == np.float32 and z["target_time"].dtype == "datetime64[ns]" and (np.isnan(z["X_z"]) == ~z["X_mask"]).all()
    back = windows.from_arrays(npz.read(spark, out, place=True), keys=())
    short = lambda v: None if v is None else float(np.float32(v))
    key = lambda r: (r.context_end, short(r.end_value), [[short(v) for v in c] for c in r.context], [(f.ts, short(f.y), short(f.w)) for f in r.future])
    assert sorted(map(repr, map(key, back.collect()))) == sorted(map(repr, map(key, found.collect())))
    npz.write(windows.arrays_of(found.limit(2)), out)  # what stood there goes
    assert npz.read(spark, out).count() == 2


def test_files_of_one_target(spark, tmp_path):
    """Older files: one target, no masks of their own, infinities."""
    np.savez(tmp_path / "old.npz", X_z=np.ones((3, 2, 2), np.float32), X_mask=np.array([[[True, False], [True, True]]] * 3), y_z=np.array([1.5, np.inf, np.nan], np.float32))
    got = windows.from_arrays(npz.read(spark, str(tmp_path / "old.npz"), place=True)).orderBy("window_id").collect()
    assert [[f.y for f in r.future] for r in got] == [[1.5], [None], [None]] and [c.f1 for c in got[0].context] == [None, 1.0]
