"""Sources, sinks and reports over files that are made from the given tables, each beside the SQL of the same result.

events, dealt to three files by event_id, are the yearly logs: one file lacks a
flag column, one has bad dates and values; times are cut to the hour, so that
there are many rows of one time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.functions import scalars as S
from weirflow.operators import metrics, ordering, splits, windows
from weirflow.plans import pipelines
from weirflow.plans.queries import SQL, _FORECAST, _LAST, _MONTHS, _OK, _P, _PANEL, _SCALER, _WIDE, _WINDOWS, CHANNELS, events, forecast, long_rows, panel, query, six, table, wide, window_rows
from weirflow.sources import artifacts, npz, sensor_logs, versions
from weirflow.sources.scratch import fresh_folder, one_file

_FILES = ("log_2014.csv", "log_2015.csv", "log_2016.csv")
_LOG = """log_ AS (SELECT event_id, 'log_' || CAST(2014 + event_id % 3 AS varchar) || '.csv' AS file, date_trunc('hour', ts) AS t,
CASE WHEN event_id % 11 = 0 OR (event_id % 3 = 2 AND event_id % 17 = 0) THEN NULL ELSE value END AS a,
CASE WHEN event_id % 3 = 2 THEN NULL WHEN event_type = 'error' THEN 'B7' WHEN event_type = 'view' THEN 'C' WHEN event_type = 'click' THEN NULL ELSE 'A6' END AS a_flag,
CAST(json_extract(props, '$.k') AS double) AS b, CASE WHEN event_id % 3 = 1 AND event_id % 5 = 0 THEN 'M' END AS b_flag FROM events WHERE NOT (event_id % 3 = 2 AND event_id % 13 = 0))"""


def logs(spark: SparkSession, sf_dir: str) -> str:
    """The glob of three CSV logs."""
    folder = fresh_folder(spark, "logs")
    rows = events(spark, sf_dir)
    third, a = F.col("event_id") % 3, F.col("value").cast("string")
    shown = rows.select(
        third.alias("third"),
        F.when((third == 2) & (F.col("event_id") % 13 == 0), "no date").otherwise(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss")).alias("DateTime"),
        F.when(F.col("event_id") % 11 == 0, "NA").when((third == 2) & (F.col("event_id") % 17 == 0), "junk").otherwise(a).alias("A"),
        F.when(F.col("event_type") == "error", "B7").when(F.col("event_type") == "view", " C ").when(F.col("event_type") == "click", "").otherwise("A6").alias("A_Flag"),
        F.get_json_object("props", "$.k").alias("B"),
        F.when(F.col("event_id") % 5 == 0, "M").otherwise("").alias("B_Flag"),
    )
    names = (["DateTime", "A", "A_Flag", "B"], ["DateTime", "A", "A_Flag", "B", "B_Flag"], ["DateTime", "A", "B"])
    for k, (file, columns) in enumerate(zip(_FILES, names, strict=True)):
        one_file(shown.where(F.col("third") == k).select(*columns), f"{folder}/{file}", header=True, emptyValue="")
    return f"{folder}/*.csv"


# -- logs ---------------------------------------------------------------------------------------------------------


@query(f"WITH {_LOG} SELECT file AS source_file, count(*) AS n, count(a) AS n_a, count(a_flag) AS n_a_flag, count(b) AS n_b, count(b_flag) AS n_b_flag, min(t) AS first, max(t) AS last FROM log_ GROUP BY 1")
def scan_logs(spark, sf_dir):
    """Files of different headers as one frame, with the file of each row."""
    rows = sensor_logs.scan(spark, logs(spark, sf_dir), ["A", "B"])
    counts = [F.count(c).alias(f"n_{c.lower()}") for c in ("A", "A_Flag", "B", "B_Flag")]
    return rows.groupBy("source_file").agg(F.count("*").alias("n"), *counts, F.min("DateTime").alias("first"), F.max("DateTime").alias("last"))


@query(f"WITH {_LOG} SELECT t, round(a, 6) AS a, file AS source_file FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY file, a NULLS FIRST) AS r FROM log_ WHERE a_flag IS NULL OR a_flag NOT IN ('B7', 'C', 'M')) WHERE r = 1")
def trimmed_log(spark, sf_dir):
    rows = sensor_logs.trimmed_target(spark, logs(spark, sf_dir), "A")
    return six(rows.select(F.col("DateTime").alias("t"), F.col("A").alias("a"), "source_file"), "a")


@query(f"WITH {_LOG}, m AS (SELECT t, file, CASE WHEN a_flag IN ('B7', 'C', 'M') THEN NULL ELSE a END AS a, CASE WHEN b_flag = 'M' THEN NULL ELSE b END AS b FROM log_) SELECT t, round(a, 6) AS a, round(b, 6) AS b FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY file, a NULLS FIRST, b NULLS FIRST) AS r FROM m) WHERE r = 1")
def masked_logs(spark, sf_dir):
    rows = sensor_logs.masked_series(spark, logs(spark, sf_dir), ["A", "B"], require=True)
    return six(rows.select(F.col("DateTime").alias("t"), F.col("A").alias("a"), F.col("B").alias("b")), "a", "b")


@query(f"WITH {_LOG} SELECT CAST(year(t) AS int) AS year, file AS source_file, count(*) AS n, count(a) AS n_a, count(b) AS n_b FROM log_ GROUP BY 1, 2")
def all_years_of_logs(spark, sf_dir):
    """Every column of every file, neither sorted nor deduplicated; the columns that a plot can take."""
    rows = sensor_logs.all_years(spark, logs(spark, sf_dir))
    counts = [F.count(c).alias(f"n_{c.lower()}") for c in sensor_logs.plottable(rows)]
    return rows.groupBy(F.col("Year").alias("year"), "source_file").agg(F.count("*").alias("n"), *counts)


@query(f"""WITH {_LOG}, s AS (SELECT t, a FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY file, a NULLS FIRST) AS r FROM log_ WHERE a_flag IS NULL OR a_flag NOT IN ('B7', 'C', 'M')) WHERE r = 1),
d AS (SELECT date_trunc('month', t) AS m, count(DISTINCT CAST(t AS date)) AS n FROM s GROUP BY 1), ok AS (SELECT m FROM d WHERE n / CAST(day(last_day(m)) AS double) >= 0.8),
k AS (SELECT t, file, CASE WHEN a_flag IN ('B7', 'C', 'M') THEN NULL ELSE a END AS a, CASE WHEN b_flag = 'M' THEN NULL ELSE b END AS b FROM log_),
f AS (SELECT t, a, b FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY file, b NULLS FIRST, a NULLS FIRST) AS r FROM k) WHERE r = 1 AND date_trunc('month', t) IN (SELECT m FROM ok)),
g AS (SELECT time_bucket(interval '6 hours', t - interval '1 microsecond', timestamp '2000-01-01') + interval '6 hours' AS bin, quantile_cont(a, 0.5) AS a, quantile_cont(b, 0.5) AS b, count(a) AS na, count(b) AS nb FROM f GROUP BY 1),
x AS (SELECT unnest(generate_series(min(bin), max(bin), interval '6 hours')) AS bin FROM g)
SELECT x.bin, round(a, 6) AS a, round(b, 6) AS b, coalesce(na, 0) AS n_obs_a, coalesce(nb, 0) AS n_obs_b FROM x LEFT JOIN g USING (bin)""")
def panel_of_passing_months(spark, sf_dir):
    """From the logs to the panel, months below the coverage left out."""
    found = pipelines.panel(spark, logs(spark, sf_dir), pipelines.TrainingSet(freq="6h", p=0.8), ["B"], "A")
    return six(found.select(F.col("DateTime").alias("bin"), F.col("A").alias("a"), F.col("B").alias("b"), F.col("n_obs_A").alias("n_obs_a"), F.col("n_obs_B").alias("n_obs_b")), "a", "b")


@query("SELECT 'A' || CAST(n_nationkey AS varchar) AS flag, n_name || ', \"kept\"' AS definition FROM nation")
def flag_definitions(spark, sf_dir):
    """A dictionary with quoted commas and quotes, and blanks around codes."""
    nation = table(spark, sf_dir, "nation")
    shown = nation.select(F.concat(F.lit(" A"), F.col("n_nationkey").cast("string")).alias("Flag"), F.concat("n_name", F.lit(', "kept"')).alias("Definition"))
    path = one_file(shown, f"{fresh_folder(spark, 'flags')}/flags.csv", header=True, quoteAll=True, escape='"')
    return sensor_logs.flag_dictionary(spark, path)


@query("""WITH w AS (SELECT date_trunc('hour', ts) AS t, event_id, least(greatest(CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE (event_id % 30) / 10.0 - 1 END, 0.0), 1.0) AS w, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END AS c FROM events)
SELECT t, round(w, 6) AS weight_chl_gt, round(c, 6) AS weight_chl_gt_conservative FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY w, c) AS r FROM w) WHERE r = 1""")
def weight_table(spark, sf_dir):
    """Weights from a CSV: what is no number weighs nothing, all within [0, 1], one row for each time."""
    rows = events(spark, sf_dir).select(
        F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("DateTime"),
        F.when(F.col("event_id") % 7 == 0, "none").otherwise(((F.col("event_id") % 30) / 10.0 - 1).cast("string")).alias("weight_chl_gt"),
        F.when(F.col("event_type") == "error", "0").otherwise("1").alias("weight_chl_gt_conservative"),
    )
    path = one_file(rows, f"{fresh_folder(spark, 'weights')}/weights.csv", header=True)
    found = sensor_logs.weight_table(spark, path, "weight_chl_gt")
    return six(found.select(F.col("DateTime").alias("t"), "weight_chl_gt", "weight_chl_gt_conservative"), "weight_chl_gt", "weight_chl_gt_conservative")


_KEPT = f"""{_LOG}, s AS (SELECT t, a FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY file, a NULLS FIRST) AS r FROM log_ WHERE a_flag IS NULL OR a_flag NOT IN ('B7', 'C', 'M')) WHERE r = 1),
c AS (SELECT date_trunc('month', t) AS m, count(DISTINCT CAST(t AS date)) AS n FROM s GROUP BY 1), ok AS (SELECT m FROM c WHERE n / CAST(day(last_day(m)) AS double) >= 0.8),
kept AS (SELECT t AS ts, a AS value FROM s WHERE date_trunc('month', t) IN (SELECT m FROM ok)),
h1 AS (SELECT *, CASE WHEN count(value) OVER f >= 6 THEN quantile_cont(value, 0.5) OVER f END AS med FROM kept WINDOW f AS (ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
h2 AS (SELECT *, CASE WHEN count(abs(value - med)) OVER f >= 6 THEN quantile_cont(abs(value - med), 0.5) OVER f END AS mad FROM h1 WINDOW f AS (ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
h AS (SELECT *, coalesce(mad > 1e-12 AND abs(value - med) > 3.0 * 1.4826 * mad, false) AS spike FROM h2),
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM kept), daily AS (SELECT CAST(ts AS date) AS day, quantile_cont(value, 0.5) AS m FROM kept WHERE value IS NOT NULL GROUP BY 1), {_MONTHS}"""


@query(f"""WITH {_KEPT} SELECT CAST(ts AS date) AS day, count(*) AS n, count(*) FILTER (spike) AS n_spike, count(*) FILTER (coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), false)) AS n_potential,
count(*) FILTER (coalesce(potential, false)) AS n_monthly, CAST(count(*) FILTER (NOT (spike AND coalesce(potential, false))) AS double) AS weight_conservative, round(any_value(tukey.m), 6) AS daily_median FROM h CROSS JOIN q LEFT JOIN tukey ON tukey.day = CAST(ts AS date) GROUP BY 1""")
def stored_ground_truth(spark, sf_dir):
    """Audit, series, labels, daily medians and summary of the logs as stored; the labels and medians read back by day."""
    folder = fresh_folder(spark, "truth")
    pipelines.store(pipelines.ground_truth(spark, logs(spark, sf_dir), pipelines.GroundTruth(p=0.8, freq="1h"), "A"), folder)
    labels, daily = (spark.read.parquet(f"{folder}/{k}") for k in ("labels", "daily"))
    flags = [F.count_if(c).alias(n) for c, n in (("spike", "n_spike"), ("tukey_potential", "n_potential"), ("monthly_potential", "n_monthly"))]
    by_day = labels.groupBy(F.to_date("DateTime").alias("day")).agg(F.count("*").alias("n"), *flags, F.sum("weight_conservative").alias("weight_conservative"))
    return six(by_day.join(daily.select("day", "daily_median"), "day", "left"), "daily_median")


# -- sinks and what reads them ------------------------------------------------------------------------------------


@query(f"WITH {_PANEL} SELECT bin, round(value, 6) AS value, n_obs_value, CAST(year(bin) AS int) AS year FROM panel")
def stored_panel(spark, sf_dir):
    """A stage written as Parquet by partitions and read again."""
    folder = fresh_folder(spark, "panel")
    pipelines.store({"panel": panel(spark, sf_dir).withColumn("year", F.year("bin"))}, folder, {"panel": ["year"]})
    return six(spark.read.parquet(f"{folder}/panel").select("bin", "value", "n_obs_value", F.col("year").cast("int").alias("year")), "value")


@query(f"WITH {_PANEL} SELECT '30min' AS freq, 'median' AS agg, 1800000000::bigint AS step_micros, count(*) AS n_rows, min(bin) AS first, max(bin) AS last, sum(n_obs_value)::bigint AS n_obs_value FROM panel")
def panel_meta(spark, sf_dir):
    """What a panel was made with and what it holds, as stored beside it."""
    folder = f"{fresh_folder(spark, 'panel')}/p"
    pipelines.store_panel(panel(spark, sf_dir), folder, "bin", "30min", "median")
    return spark.read.json(f"{folder}_meta").select("freq", "agg", F.col("step_micros").cast("long").alias("step_micros"), "n_rows", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n_obs_value")


@query(f"WITH {_WINDOWS} SELECT split, window_id, CAST(step AS int) AS step, epoch_us(ts) AS ts_micros, round(y, 6) AS y, round(end_value, 6) AS end_value FROM win")
def stored_windows(spark, sf_dir):
    """Windows written by split and read again: times as microseconds, the target by whichever form is there."""
    folder = f"{fresh_folder(spark, 'windows')}/w"
    windows.store(windows.require_windows(window_rows(spark, sf_dir)), folder, {"upstream": "panel"})
    rows = windows.load(spark, folder)
    return six(windows.long_form(rows).select("split", "window_id", "step", S.micros(F.col("ts")).alias("ts_micros"), "y", "end_value"), "y", "end_value")


@query(f"WITH {_WINDOWS}, kept AS (SELECT DISTINCT split, window_id FROM win) SELECT split, count(*) AS n_windows, {_LAST + 1}::bigint AS context, {_P}::bigint AS future, 6::bigint AS channels, 'panel' AS upstream FROM kept GROUP BY 1")
def windows_manifest(spark, sf_dir):
    """The sidecar of stored windows: shapes, and what they were made from."""
    folder = f"{fresh_folder(spark, 'windows')}/w"
    windows.store(window_rows(spark, sf_dir), folder, {"upstream": "panel"})
    return spark.read.json(f"{folder}_manifest").select("split", "n_windows", "context", "future", "channels", "upstream")


@query(f"WITH {_WINDOWS}, ta AS (SELECT split, window_id, sum(y) AS total, count(y) AS n FROM win GROUP BY 1, 2), tb AS (SELECT split, window_id, y AS total, 1 AS n FROM win WHERE step = 0) SELECT 'targets' AS form, split, count(*) AS windows, round(sum(total), 4) AS total, sum(n)::bigint AS n FROM ta GROUP BY 2 UNION ALL SELECT 'target' AS form, split, count(*) AS windows, round(sum(total), 4) AS total, sum(n)::bigint AS n FROM tb GROUP BY 2")
def either_target(spark, sf_dir):
    """Window rows of one target or of many are read alike."""
    ys = F.transform("future", lambda f: f["y"])
    rows = window_rows(spark, sf_dir)
    both = {"targets": rows.select("split", ys.alias("targets")), "target": rows.select("split", F.col("future")[0]["y"].alias("target"))}
    total = F.aggregate("y", F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    n = F.size(F.filter("y_valid", lambda x: x)).cast("long")
    found = [artifacts.any_target(df).groupBy("split").agg(F.count("*").alias("windows"), F.round(F.sum(total), 4).alias("total"), F.sum(n).alias("n")).withColumn("form", F.lit(form)) for form, df in both.items()]
    return found[0].unionByName(found[1]).select("form", "split", "windows", "total", "n")


@query(f"WITH {_WIDE}, {_SCALER} SELECT 'zscore' AS method, 'k' AS target, name, round(mean, 6) AS mean, round(std, 6) AS std FROM sc")
def scaler_json(spark, sf_dir):
    """A fitted scaler as JSON and back."""
    fitted = splits.fit_scaler(wide(spark, sf_dir).where("split = 'train'"), [*CHANNELS, "k"])
    text = spark.createDataFrame([(artifacts.scaler_json(fitted, "k"),)], "value string")
    path = one_file(text, f"{fresh_folder(spark, 'scaler')}/scaler.json", "text")
    return six(artifacts.scaler(spark, path).select("method", "target", F.explode("scaler").alias("name", "s")).select("method", "target", "name", "s.mean", "s.std"), "mean", "std")


_RUNS = "(VALUES ('gru', 'resampled_30min', 'windowed_L96_H0_P48_S1', 'checkpoints'), ('slide', 'resampled_30min', 'windowed_L96_H0_P48_S1', 'checkpoints_slide'), ('slide', 'resampled_1h', 'windowed_L48_H0_P24_S2', 'checkpoints_slide_student')) r(model, resample, window_, run)"


@query(f"SELECT CASE WHEN contains(run, 'student') THEN model || '_student' ELSE model END AS model, resample, window_ AS window, round((SELECT avg(value) FROM events WHERE event_id % 3 = length(run) % 3), 6) AS val_rmse, round((SELECT max(value) FROM events WHERE event_id % 3 = length(run) % 3), 6) AS test_rmse FROM {_RUNS}")
def leaderboard(spark, sf_dir):
    """Summaries of runs below a folder, one of them no JSON."""
    root = fresh_folder(spark, "runs")
    runs = (("gru", "resampled_30min", "windowed_L96_H0_P48_S1", "checkpoints"), ("slide", "resampled_30min", "windowed_L96_H0_P48_S1", "checkpoints_slide"), ("slide", "resampled_1h", "windowed_L48_H0_P24_S2", "checkpoints_slide_student"))
    for k, (model, resampled, window, run) in enumerate(runs):
        stats = events(spark, sf_dir).where(F.col("event_id") % 3 == len(run) % 3).agg(F.avg("value").alias("val_rmse_chl" if k else "val_rmse"), F.max("value").alias("test_rmse_chl"))
        one_file(stats.select(F.to_json(F.struct("*"))), f"{root}/{resampled}/normalized_split/{window}/{run}/{model}_eval_summary.json", "text")
    one_file(spark.createDataFrame([("no json",)], "value string"), f"{root}/resampled_1h/normalized_split/windowed_L1_H0_P1_S1/checkpoints/bad_eval_summary.json", "text")
    return six(artifacts.leaderboard(spark, root), "val_rmse", "test_rmse")


@query("SELECT n_name || '.csv' AS name, sha256(n_name || chr(10)) AS sha256, octet_length(encode(n_name)) + 1 AS size, true AS whole FROM nation WHERE n_nationkey < 5 UNION ALL SELECT r_name || '.json' AS name, sha256(r_name || chr(10)) AS sha256, octet_length(encode(r_name)) + 1 AS size, true AS whole FROM region")
def artifact_fingerprints(spark, sf_dir):
    """Hashes of the files below a folder that match patterns by path; others are left out."""
    root = fresh_folder(spark, "artifacts")
    for name in [r.n_name for r in table(spark, sf_dir, "nation").where("n_nationkey < 5").collect()]:
        one_file(spark.createDataFrame([(name,)], "value string"), f"{root}/processed/{name}.csv", "text")
        one_file(spark.createDataFrame([(name,)], "value string"), f"{root}/elsewhere/{name}.csv", "text")
    for name in [r.r_name for r in table(spark, sf_dir, "region").collect()]:
        one_file(spark.createDataFrame([(name,)], "value string"), f"{root}/processed/deep/{name}.json", "text")
    found = artifacts.fingerprints(spark, root, ("processed/*.csv", "processed/*/*.json"))
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256", "size", "whole")


@query("SELECT r_name || '.pt' AS name, octet_length(encode(r_name)) + 1 AS size FROM region")
def large_artifacts(spark, sf_dir):
    """Names and sizes alone of the files of given endings."""
    root = fresh_folder(spark, "artifacts")
    for name in [r.r_name for r in table(spark, sf_dir, "region").collect()]:
        for ending in ("pt", "txt"):
            one_file(spark.createDataFrame([(name,)], "value string"), f"{root}/models/{name}.{ending}", "text")
    found = artifacts.large_artifacts(spark, root)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "size")


@query("SELECT r_name || '.csv' AS name, octet_length(encode(r_name)) + 1 + v.v AS size, v.v + 1 AS number, v.v = 1 AS latest, true AS git FROM region, (VALUES (0), (1)) v(v)")
def snapshot(spark, sf_dir):
    """Fingerprints and the state of the run, stored twice: the first snapshot stays as it was, the last one is named."""
    root, out = fresh_folder(spark, "artifacts"), fresh_folder(spark, "snapshot")
    names = [r.r_name for r in table(spark, sf_dir, "region").collect()]
    found = None
    for more in ("", "x"):
        for name in names:
            one_file(spark.createDataFrame([(name + more,)], "value string"), f"{root}/{name}.csv", "text")
        artifacts.snapshot(spark, root, out)
    latest = spark.read.json(f"{out}/latest").select(F.col("number").alias("last"))
    for v in versions.versions(spark, out):
        own = versions.read(spark, out, "files", v["number"]).withColumn("number", F.lit(v["number"])).crossJoin(F.broadcast(versions.read(spark, out, "run", v["number"])))
        found = own if found is None else found.unionByName(own)
    git = F.get_json_object("git", "$.revision_error").isNotNull()  # the folder is no repository, and that is recorded
    return found.crossJoin(F.broadcast(latest)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", F.col("number").cast("int").alias("number"), (F.col("number") == F.col("last")).alias("latest"), git.alias("git"))


@query(f"WITH {_PANEL} SELECT bin, round(value, 6) AS value, n_obs_value, 1 AS number FROM panel UNION ALL SELECT bin, round(value * 2, 6), n_obs_value, 2 FROM panel")
def published_panel(spark, sf_dir):
    """Two versions of a panel, the second published while the first is open; both are read."""
    root, rows = fresh_folder(spark, "published"), panel(spark, sf_dir)
    versions.publish({"panel": rows}, root)
    first = versions.read(spark, root, "panel")
    versions.publish({"panel": rows.withColumn("value", F.col("value") * 2)}, root)
    both = first.withColumn("number", F.lit(1)).unionByName(versions.read(spark, root, "panel").withColumn("number", F.lit(2)))
    return six(both.select("bin", "value", "n_obs_value", "number"), "value")


@query("SELECT 'windowed_L96_H0_P48_S' || CAST(n_regionkey + 1 AS varchar) AS name, CAST(n_regionkey + 1 AS bigint) AS stride FROM nation ORDER BY n_regionkey, n_nationkey LIMIT 1")
def pick_window_dir(spark, sf_dir):
    """Of the folders' names that of least stride; those without come last, others do not count."""
    names = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") == 3, "windowed_L1_H0_P1_Sx").when(F.col("n_nationkey") == 4, "other_S0").otherwise(F.concat(F.lit("windowed_L96_H0_P48_S"), F.col("n_regionkey") + 1)).alias("name"))
    return artifacts.pick_window_dir(names).select("name", "stride")


_ARRAYS = f"""WITH {_WINDOWS}, c AS (SELECT w.split, w.window_id, avg((coalesce(x.click, 0)::float)::double) AS click, count(x.k) AS k_valid FROM (SELECT DISTINCT split, window_id FROM win) w JOIN i x ON x.split = w.split AND x.r BETWEEN w.window_id AND w.window_id + {_LAST} GROUP BY 1, 2),
f AS (SELECT split, window_id, context_end, sum((y::float)::double) AS y, count(y) AS n, max(ts) AS last, max((end_value::float)::double) AS end_value FROM win GROUP BY 1, 2, 3)"""


@query(f"{_ARRAYS} SELECT split, context_end, last, round(click, 4) + 0.0 AS click, k_valid, round(y, 4) + 0.0 AS y, n, round(end_value, 4) + 0.0 AS end_value FROM c JOIN f USING (split, window_id)")
def npz_windows(spark, sf_dir):
    """All windows written as NPZ files for each split and read back by ranges of rows."""
    folder = fresh_folder(spark, "npz")
    found = window_rows(spark, sf_dir).persist()
    back = None
    for split in ("train", "val", "test"):
        npz.write(windows.arrays_of(found.where(F.col("split") == split)), f"{folder}/{split}", lineage={"upstream": "panel"}, file_bytes=8 << 20)
        own = windows.from_arrays(npz.read(spark, f"{folder}/{split}", place=True, range_bytes=2 << 20)).withColumn("split", F.lit(split))
        back = own if back is None else back.unionByName(own)
    found.unpersist()
    click = F.transform("context", lambda x: F.coalesce(x[f"f{CHANNELS.index('click')}"], F.lit(0.0)))
    y = F.array_compact(F.transform("future", lambda x: x["y"]))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    four = lambda c: F.round(c, 4) + F.lit(0.0)
    return back.select("split", "context_end", F.element_at("future", -1)["ts"].alias("last"), four(total(click) / F.size("context")).alias("click"), F.size(F.filter("context", lambda x: x["y"].isNotNull())).cast("long").alias("k_valid"), four(total(y)).alias("y"), F.size(y).cast("long").alias("n"), four("end_value").alias("end_value"))


@query(f"WITH {_WINDOWS} SELECT split, count(*) AS n_windows, sum(CASE WHEN y IS NULL THEN 0 ELSE 1 END)::bigint AS n_valid FROM (SELECT *, window_id % 2 = 1 AND y < 0 AS masked FROM win) WHERE step = 0 AND NOT masked GROUP BY 1")
def npz_targets(spark, sf_dir):
    """Targets of files of one target each: what the mask leaves out or is no finite number does not count."""
    folder = f"{fresh_folder(spark, 'npz')}/w"
    first = F.col("future")[0]["y"]
    hidden = (F.col("window_id") % 2 == 1) & (first < 0)
    shown = F.when(hidden & (F.col("window_id") % 4 == 1), F.lit(float("inf"))).otherwise(first)
    npz.write(window_rows(spark, sf_dir).select("split", F.transform("context", lambda x: F.array(x["f0"].cast("float"))).alias("X_z"), shown.alias("y_z"), (first.isNotNull() & ~(hidden & (F.col("window_id") % 4 != 1))).alias("y_mask")), folder, compressed=True)
    rows = artifacts.any_target(npz.read(spark, folder, ["split", "y_z", "y_mask"]))
    return rows.where(F.col("y_valid")[0]).groupBy("split").agg(F.count("*").alias("n_windows"), F.count(F.col("y")[0]).alias("n_valid"))


# -- reports of forecasts -----------------------------------------------------------------------------------------


@query(f"WITH {_FORECAST} SELECT split, window_id, CAST(step AS int) AS step, CAST(row_number() OVER (PARTITION BY split ORDER BY window_id * 100000 + step) - 1 AS bigint) AS place, round(y_hat, 6) AS y_hat FROM fc WHERE y_hat IS NOT NULL")
def numbered_rows(spark, sf_dir):
    """Places in an order without one task that holds it."""
    rows = forecast(spark, sf_dir).where("y_hat is not null").select("split", "window_id", "step", "y_hat", S.from_micros((F.col("window_id") * 100000 + F.col("step")) * 1_000_000).alias("at"))
    return six(ordering.numbered(rows, "at", ["step"], ["split"]).select("split", "window_id", "step", F.col("_r").alias("place"), "y_hat"), "y_hat")


@query(f"WITH {_FORECAST} SELECT window_id, CAST(step AS int) AS step, ts, round(end_value, 6) AS y_hat, row_number() OVER (ORDER BY ts, window_id, step) - 1 AS place FROM win WHERE split = 'test'")
def sorted_predictions(spark, sf_dir):
    """Predictions as stored for plots: ordered by target time; each with its place in the stored files."""
    folder = fresh_folder(spark, "predictions")
    rows = metrics.persistence_baseline(long_rows(spark, sf_dir).where("split = 'test'"), require=True)
    pipelines.store({"predictions": metrics.by_target_time(rows)}, folder)
    kept = spark.read.parquet(f"{folder}/predictions").select("window_id", "step", "ts", "y_hat", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = kept.groupBy("file").agg(F.count("*").alias("n"))  # a row a file
    before = files.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return six(kept.join(F.broadcast(before), "file").select("window_id", "step", "ts", "y_hat", (F.col("before") + F.col("row")).alias("place")), "y_hat")


@query(SQL["baselines"])
def stored_metrics(spark, sf_dir):
    """The baselines' errors as the JSON that a run leaves, read back."""
    folder = fresh_folder(spark, "metrics")
    sensor_logs.write(pipelines.baseline_report(long_rows(spark, sf_dir)), f"{folder}/metrics", fmt="json")
    rows = spark.read.schema("split string, method string, rmse double, mae double, n long").json(f"{folder}/metrics")
    return six(rows, "rmse", "mae")


@query(f"""SELECT 'missing' AS report, split, "column", missing AS value FROM ({SQL['missing_rates']}) UNION ALL SELECT 'q75', split, "column", q75 FROM ({SQL['describe']}) UNION ALL SELECT 'n', split, "column", n FROM ({SQL['describe']})""")
def stored_exploration(spark, sf_dir):
    """The exploration's bundle as stored: rates of missing values and descriptions of each split."""
    folder = fresh_folder(spark, "exploration")
    found = pipelines.exploration(wide(spark, sf_dir), [*CHANNELS, "k"])
    pipelines.store({k: found[k] for k in ("missing", "describe")}, folder)
    missing, described = (spark.read.parquet(f"{folder}/{k}") for k in ("missing", "describe"))
    part = lambda df, name, c: df.select(F.lit(name).alias("report"), "split", "column", F.col(c).cast("double").alias("value"))
    return six(part(missing, "missing", "missing").unionByName(part(described, "q75", "q75")).unionByName(part(described, "n", "n")), "value")


@query(f"WITH {_FORECAST} SELECT split, round(sqrt(avg((y - (0.9 * (y - end_value) + end_value)) * (y - (0.9 * (y - end_value) + end_value)))), 6) AS rmse, count(*) AS n FROM fc WHERE {_OK} GROUP BY 1")
def from_delta(spark, sf_dir):
    """Levels from predicted changes."""
    rows = metrics.delta_target(forecast(spark, sf_dir)).withColumn("delta_hat", F.col("delta") * 0.9)
    return six(metrics.errors(metrics.from_delta(rows), ["split"]).select("split", "rmse", "n"), "rmse")


@query("""WITH f AS (SELECT CAST(l_quantity AS bigint) AS q, l_returnflag AS u, count(*) AS n FROM lineitem GROUP BY 1, 2),
m AS (SELECT q, u, n, CASE u WHEN 'A' THEN ' min' WHEN 'N' THEN 'h' ELSE 'M' END AS unit, CASE u WHEN 'A' THEN 60000000 WHEN 'N' THEN 3600000000 END * q AS us FROM f)
SELECT CAST(q AS varchar) || unit AS freq, n, coalesce(us, -1)::bigint AS micros, CASE WHEN us IS NULL THEN -1 ELSE greatest(7, CAST(round_even(86400000000.0 / us, 0) AS bigint) | 1) END::bigint AS hampel_rows, CAST(q AS varchar) || replace(unit, ' ', '_') AS slug FROM m""")
def frequencies(spark, sf_dir):
    """Lengths of time, the Hampel window of a day in rows, and slugs, of all quantities and return flags; lengths that vary are refused."""
    unit = F.when(F.col("l_returnflag") == "A", " min").when(F.col("l_returnflag") == "N", "h").otherwise("M")
    found = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.col("l_quantity").cast("long").cast("string"), unit).alias("freq")).agg(F.count("*").alias("n"))

    def each(batches):
        for rows in batches:
            for freq in rows.freq:
                try:
                    rows.loc[rows.freq == freq, ["micros", "hampel_rows"]] = S.freq_micros(freq), S.hampel_rows(24, freq)
                except ValueError:
                    rows.loc[rows.freq == freq, ["micros", "hampel_rows"]] = -1, -1
                rows.loc[rows.freq == freq, "slug"] = S.slug_of(freq)
            yield rows.astype({"micros": "int64", "hampel_rows": "int64"}) if len(rows) else rows

    return found.mapInPandas(each, "freq string, n long, micros long, hampel_rows long, slug string")


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 OR value IS NULL THEN '{}' ELSE '{\"v\":' || CAST(event_id AS varchar) || '.0}' END AS json FROM events")
def json_safe_floats(spark, sf_dir):
    """NaN and infinities are left out of JSON."""
    v = F.when(F.col("event_id") % 10 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, F.lit(float("inf"))).when(F.col("value").isNotNull(), F.col("event_id").cast("double"))
    return events(spark, sf_dir).select("event_id", F.to_json(F.struct(S.json_safe(v).alias("v"))).alias("json"))
