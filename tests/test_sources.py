"""Logs, dictionaries, artifacts, pipelines and the command line on files made here."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from weirflow.plans import pipelines
from weirflow.operators import windows
from weirflow.sources import artifacts, sensor_logs
from weirflow.sources.sensor_logs import FEATURES, TARGET, SensorSchema

HEAD = ["DateTime", *FEATURES, TARGET, *(f"{c}_Flag" for c in (*FEATURES, TARGET))]


def line(ts, values, flags=None):
    return ",".join([ts, *map(str, values), *(flags or [""] * 6)])


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    first = [",".join(HEAD)]
    first += [line("2014-06-30 23:50:00", [1, 2, 3, 4, 5, 6], ["", "", "", "", "", "B7"]), line("2014-07-01 00:00:00", [1, "NA", 3, 4, 5, 6.5]), line("2014-07-01 00:00:00", [9, 9, 9, 9, 9, 7.5])]
    first += [line("2014-07-01 00:10:00", ["x", 2, 3, 4, 5, 6], [" C ", "", "", "", "", "A6"]), line("no date", [1] * 6), line("2014-07-31 00:00:00", [1, 2, 3, 4, 5, ""], ["", "", "", "", "", "M"])]
    (root / "Buoy2014.csv").write_text("\n".join(first) + "\n")
    short = [c for c in HEAD if c != f"{FEATURES[0]}_Flag"]  # a file that lacks a flag column, in other order
    order = [short[0], *short[1:][::-1]]
    day = dt.datetime(2015, 6, 1)
    body = []
    for i in range(6 * 24 * 30):
        at = day + dt.timedelta(minutes=10 * i)
        row = dict(zip(HEAD, [str(at), *(str(k + (i % 17) / 10) for k in range(5)), str(2 + (i % 23) / 10 + (40 if i % 500 == 250 else 0)), *[""] * 6], strict=True))
        body.append(",".join(row[c] for c in order))
    (root / "Buoy2015.csv").write_text("\n".join([",".join(order), *body]) + "\n")
    return f"{root}/Buoy*.csv"


def test_scan(spark, logs):
    rows = sensor_logs.scan(spark, logs, [*FEATURES, TARGET])
    assert rows.count() == 5 + 4320
    assert {r.source_file for r in rows.select("source_file").distinct().collect()} == {"Buoy2014.csv", "Buoy2015.csv"}
    by = {(r.DateTime, r[TARGET]): r for r in rows.where("DateTime < '2015-01-01'").collect()}
    edge = by[dt.datetime(2014, 7, 1, 0, 10), 6.0]
    assert edge[FEATURES[0]] is None and edge[f"{FEATURES[0]}_Flag"] == "C"
    with pytest.raises(FileNotFoundError):
        sensor_logs.scan(spark, logs.replace("Buoy", "None"))
    with pytest.raises(ValueError):
        sensor_logs.scan(spark, logs, ["absent"])
    everything = sensor_logs.all_years(spark, logs)
    assert set(sensor_logs.plottable(everything)) == {*FEATURES, TARGET} and {r.Year for r in everything.select("Year").distinct().collect()} == {2014, 2015}
    assert SensorSchema().flags[-1] == f"{TARGET}_Flag" and TARGET in SensorSchema().describe()


def test_trimmed_and_masked(spark, logs):
    trimmed = sensor_logs.trimmed_target(spark, logs)
    got = {r.DateTime: r[TARGET] for r in trimmed.where("DateTime < '2015-01-01'").collect()}
    assert got == {dt.datetime(2014, 7, 1): 6.5, dt.datetime(2014, 7, 1, 0, 10): 6.0}
    masked = sensor_logs.masked_series(spark, logs)
    rows = {r.DateTime: r for r in masked.where("DateTime < '2015-01-01'").collect()}
    assert rows[dt.datetime(2014, 6, 30, 23, 50)][TARGET] is None and rows[dt.datetime(2014, 7, 1)][FEATURES[1]] is None and len(rows) == 4


def test_dictionary_and_weights(spark, tmp_path):
    path = tmp_path / "flags.csv"
    path.write_bytes('﻿Flag,Definition\nM,"missing, or lost"\nC,faulty\n'.encode())
    assert {(r.flag, r.definition) for r in sensor_logs.flag_dictionary(spark, str(path)).collect()} == {("M", "missing, or lost"), ("C", "faulty")}
    assert sensor_logs.flag_dictionary(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "w.csv").write_text("DateTime,weight_a,weight_b,x\n2020-01-01 00:00:00,2,,1\n2020-01-01 00:00:00,3,x,1\n2020-01-02 00:00:00,0.5,-1,1\nbad,1,1,1\n")
    got = sorted(map(tuple, sensor_logs.weight_table(spark, str(tmp_path / "w.csv")).collect()))
    assert got == [(dt.datetime(2020, 1, 1), 1.0, 0.0), (dt.datetime(2020, 1, 2), 0.5, 0.0)]


def test_pipelines(spark, logs, tmp_path):
    found = pipelines.ground_truth(spark, logs)
    audit = {r.year_month: r for r in found["audit"].collect()}
    assert len(audit) == 12 and audit["2015-06"].passes and audit["2014-09"].n_days_with_data == 0
    s = found["summary"].first()
    assert s.n_rows == 4320 and s.n_spike >= 8 and s.weight_sum == 4320 - s.n_spike
    panel = pipelines.panel(spark, logs, pipelines.TrainingSet(freq="30min", p=0.8))
    assert panel.count() == 30 * 48 + 1 and panel.agg(F.sum(f"`n_obs_{TARGET}`")).first()[0] == 4320
    settings = pipelines.TrainingSet(freq="30min", train_end="2015-06-15", val_end="2015-06-22", window=windows.WindowSettings(12, 0, 6, 6))
    made = pipelines.training_set(panel, settings)
    assert {r.split for r in made["manifest"].collect()} == {"train", "val", "test"}
    long = windows.long_form(made["windows"])
    report = pipelines.baseline_report(long)
    assert {(r.split, r.method) for r in report.collect()} == {(s, m) for s in ("val", "test") for m in ("mean", "persistence")}
    pipelines.store({"windows": made["windows"]}, str(tmp_path), {"windows": ["split"]})
    assert spark.read.parquet(f"{tmp_path}/windows").count() == made["windows"].count()
    assert set(pipelines.exploration(made["split"], [*FEATURES, TARGET], made["windows"])) == {"missing", "describe", "pearson", "spearman", "windows"}


def test_scaler_json(spark, tmp_path):
    from weirflow.operators import splits

    df = spark.createDataFrame([(1.0, 2.0), (3.0, 6.0)], "a double, t double")
    (tmp_path / "s.json").write_text(artifacts.scaler_json(splits.fit_scaler(df, ["a", "t"]), "t"))
    row = artifacts.scaler(spark, str(tmp_path / "s.json")).first()
    assert row.target == "t" and row.scaler["a"].asDict() == {"mean": 2.0, "std": 1.0} and row.scaler["t"]["std"] == 2.0


def test_artifacts(spark, tmp_path):
    for run, model, text in (("checkpoints", "gru", '{"val_rmse_chl": 1.5, "test_rmse": 2}'), ("checkpoints_student", "slide", '{"val_rmse": 1}'), ("bad", "gru", "{no json")):
        at = tmp_path / "res" / "split" / "windowed_L96_H0_P8_S48" / run
        at.mkdir(parents=True)
        (at / f"{model}_eval_summary.json").write_text(text)
    rows = [tuple(r) for r in artifacts.leaderboard(spark, str(tmp_path)).collect()]
    assert rows == [("gru", "res", "windowed_L96_H0_P8_S48", 1.5, 2.0), ("slide_student", "res", "windowed_L96_H0_P8_S48", 1.0, None)]
    dirs = spark.createDataFrame([("windowed_L96_H0_P8_S48",), ("windowed_L96_H0_P48_S6",), ("windowed_L1_H0_P1_Sx",), ("windowed_L96_H1_S1",), ("other",)], "name string")
    assert artifacts.pick_window_dir(dirs).first().name == "windowed_L96_H0_P48_S6"
    big = tmp_path / "big.npz"
    big.write_bytes(b"x" * (artifacts.WHOLE + 1))
    got = {r.path.rsplit("/", 1)[1]: r for r in artifacts.fingerprints(spark, str(tmp_path)).collect()}
    assert got["big.npz"].sha256 == hashlib.sha256(b"x" * artifacts.PREFIX).hexdigest() and not got["big.npz"].whole
    assert [r.size for r in artifacts.large_artifacts(spark, str(tmp_path)).collect()] == [artifacts.WHOLE + 1]
    snap = artifacts.snapshot(spark, str(tmp_path), str(tmp_path / "snap"), ("*.json",))
    assert artifacts.fingerprints(spark, str(tmp_path), ("res/*/*/bad/*.json", "res/**/gru_eval*")).count() == 2
    last = spark.read.json(str(tmp_path / "snap" / "latest")).first()
    assert last.number == 1 and spark.read.json(last.files).count() == 3
    assert snap.count() == 3 and "revision_error" in artifacts.git_state(str(tmp_path))
    old, new = spark.createDataFrame([(1.0,)], "target double"), spark.createDataFrame([([1.0, None],)], "targets array<double>")
    assert artifacts.any_target(old).first().y == [1.0] and artifacts.any_target(new).first().y_valid == [True, False]


def test_command_line(spark, logs, tmp_path):
    from weirflow.__main__ import main

    main(["resample", "--logs", logs, "--out", str(tmp_path), "--freq", "1h"])
    panel = f"{tmp_path}/resampled_1h"
    main(["split", "--table", panel, "--out", f"{tmp_path}/set", "--train-end", "2015-06-15", "--val-end", "2015-06-22"])
    main(["windows", "--table", f"{tmp_path}/set/split", "--out", str(tmp_path), "--context", "12", "--future", "6", "--stride", "6"])
    made = f"{tmp_path}/windowed_L12_H0_P6_S6"
    assert spark.read.json(f"{made}_manifest").first().upstream == f"{tmp_path}/set/split" and spark.read.json(f"{panel}_meta").first().freq == "1h"
    main(["train", "--windows", made, "--kind", "gru", "--out", f"{tmp_path}/model", "--epochs", "1", "--hidden", "4", "--scaler", f"{tmp_path}/set/scaler"])
    main(["predict", "--windows", made, "--model", f"{tmp_path}/model", "--out", f"{tmp_path}/pred"])
    assert spark.read.parquet(f"{tmp_path}/pred").count() == spark.read.parquet(made).count() * 6
    main(["baselines", "--table", made, "--out", f"{tmp_path}/base"])
    main(["calibrate", "--table", made, "--out", f"{tmp_path}/cal", "--block", "3"])
    main(["spans", "--logs", logs, "--out", f"{tmp_path}/spans", "--year", "2014"])
    assert spark.read.parquet(f"{tmp_path}/base").count() == 4 and spark.read.parquet(f"{tmp_path}/cal/report").count() == 2
    assert {r.flag for r in spark.read.parquet(f"{tmp_path}/spans").collect()} == {"B7", "A6", "M"}


def test_stream_equals_batch(spark, tmp_path):
    from weirflow.operators.resample import resample
    from weirflow.streaming.panel import stream_panel

    start = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(start + dt.timedelta(minutes=10 * i), float(i)) for i in range(40)], "ts timestamp_ntz, v double")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, v double").parquet(f"{tmp_path}/in")
    q = stream_panel(stream, "ts", ["v"]).writeStream.format("memory").queryName("stream_panel").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {str(r.bin): (r.v, r.n_obs_v) for r in spark.sql("select * from stream_panel").collect()}
    assert got == {str(r.bin): (r.v, r.n_obs_v) for r in resample(rows, "ts", ["v"], "30min", "mean").collect()}


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert json.dumps(sorted(e.queries()))


def test_many_files_of_few_headers(spark, tmp_path):
    """Three headers give three scans, however many files there are; quoted commas and byte-order marks stay apart."""
    heads = ["DateTime,A,A_Flag", 'DateTime,"B,x",A', "﻿DateTime,A"]
    for i in range(300):
        body = "".join(f"2020-01-01 {i % 24:02d}:{m:02d}:00,{i},{m}\n" if i % 3 < 2 else f"2020-01-01 {i % 24:02d}:{m:02d}:00,{i}\n" for m in range(3))
        (tmp_path / f"log{i:04d}.csv").write_text(heads[i % 3] + "\n" + body, encoding="utf-8")
    glob = f"{tmp_path}/log*.csv"
    files = sensor_logs.paths(spark, glob)
    found = sensor_logs.headers(spark, files)
    assert list(found) == [("DateTime", "A", "A_Flag"), ("DateTime", "B,x", "A"), ("DateTime", "A")] and [len(v) for v in found.values()] == [100, 100, 100]
    rows = sensor_logs.scan(spark, glob)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 3
    assert rows.count() == 900 and rows.select("source_file").distinct().count() == 300
    assert rows.agg(F.sum("A"), F.sum("`B,x`")).first()[:] == (sum(3 * i for i in range(300) if i % 3 != 1) + 300, sum(3 * i for i in range(300) if i % 3 == 1))


def test_versions(spark, tmp_path):
    """A write that fails leaves the version before readable; readers keep what they opened; writers of one moment take two numbers."""
    from concurrent.futures import ThreadPoolExecutor

    from weirflow.sources import versions

    root = str(tmp_path / "out")
    frame = lambda n: spark.range(n)
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root, "a")
    versions.publish({"a": frame(3), "b": frame(1)}, root, {"why": "first"})
    opened = versions.read(spark, root, "a")
    broken = frame(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("stopped half way")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="stopped half way"):
        versions.publish({"a": frame(9), "b": broken}, root)
    assert [v["number"] for v in versions.versions(spark, root)] == [1] and versions.read(spark, root, "a").count() == 3
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda n: versions.publish({"a": frame(n)}, root), (10, 20, 30, 40)))
    found = versions.versions(spark, root)
    assert [v["number"] for v in found] == [1, 2, 3, 4, 5] and found[0]["about"] == {"why": "first"}
    assert sorted(versions.read(spark, root, "a", n).count() for n in (2, 3, 4, 5)) == [10, 20, 30, 40]
    assert opened.count() == 3
    assert versions.prune(spark, root, 2) == [1, 2, 3] and [v["number"] for v in versions.versions(spark, root)] == [4, 5]
    assert len([f for f in (tmp_path / "out").iterdir() if f.name.startswith("data-")]) == 2
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root, "a", 1)


def test_files_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file of 3 GB: its prefix alone is read, or all of it in blocks."""
    big, small = tmp_path / "big.pt", tmp_path / "sub" / "small one.pt"
    small.parent.mkdir()
    small.write_bytes(b"abc")
    with open(big, "wb") as f:
        f.write(b"head")
        f.truncate(3 << 30)
    first = hashlib.sha256(b"head" + bytes((1 << 20) - 4)).hexdigest()
    rows = {r.path.rsplit("/", 1)[-1]: r for r in artifacts.fingerprints(spark, str(tmp_path), ("*.pt",)).collect()}
    assert (rows["big.pt"].sha256, rows["big.pt"].whole, rows["big.pt"].read, rows["big.pt"].size) == (first, False, 1 << 20, 3 << 30)
    assert [r.read for k, r in rows.items() if k != "big.pt"] == [3] and hashlib.sha256(b"abc").hexdigest() in {r.sha256 for r in rows.values()}
    whole = artifacts.fingerprints(spark, str(tmp_path), ("big.pt",), limit=1 << 40).first()
    assert whole.whole and whole.read == 3 << 30 and whole.sha256 != first
