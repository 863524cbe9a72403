"""The operators over the given tables, each beside the SQL of the same result.

events is the sensor log (value; event_type as flag or channel; the number in
props as target), orders the series of several years.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions import scalars as S
from weirflow.operators import calendar, calibration, metrics, models, outliers, quality_flags, resample, spans, splits, stats, windows
from weirflow.operators.ordering import join_on, keep_first
from weirflow.plans import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

CHANNELS = ("click", "error", "purchase", "signup", "view")
TRAIN_END, VAL_END = "2024-01-20", "2024-01-25"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def six(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded for comparison; -0.0 is 0.0."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


# -- panels -------------------------------------------------------------------------------------------------------

_BIN = "time_bucket(interval '30 minutes', ts - interval '1 microsecond') + interval '30 minutes'"
_PANEL = f"""b AS (SELECT {_BIN} AS bin, quantile_cont(CASE WHEN event_type <> 'error' THEN value END, 0.5) AS value,
count(CASE WHEN event_type <> 'error' THEN value END) AS n_obs_value FROM events GROUP BY 1),
s AS (SELECT unnest(generate_series(min(bin), max(bin), interval '30 minutes')) AS bin FROM b),
panel AS (SELECT s.bin, b.value, coalesce(b.n_obs_value, 0) AS n_obs_value FROM s LEFT JOIN b USING (bin))"""
_SPLIT = f"CASE WHEN bin < timestamp '{TRAIN_END}' THEN 'train' WHEN bin < timestamp '{VAL_END}' THEN 'val' ELSE 'test' END"
_WIDE = f"""w AS (SELECT {_BIN} AS bin, {", ".join(f"quantile_cont(CASE WHEN event_type = '{c}' THEN value END, 0.5) AS {c}" for c in CHANNELS)},
quantile_cont(CAST(json_extract(props, '$.k') AS double), 0.5) AS k FROM events GROUP BY 1),
t AS (SELECT unnest(generate_series(min(bin), max(bin), interval '30 minutes')) AS bin FROM w),
wide AS (SELECT t.bin, {", ".join(f"w.{c}" for c in (*CHANNELS, "k"))}, {_SPLIT.replace("bin", "t.bin")} AS split FROM t LEFT JOIN w USING (bin))"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_flags.mask_flagged(events(spark, sf_dir).select("ts", "value", "event_type"), {"value": "event_type"}, ["error"])
    return resample.resample(rows, "ts", ["value"], "30min")


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five channels and the target on the grid, with the split of each bin."""
    rows = events(spark, sf_dir).select("ts", *(F.when(F.col("event_type") == c, F.col("value")).alias(c) for c in CHANNELS), F.get_json_object("props", "$.k").try_cast("double").alias("k"))
    return splits.split(resample.resample(rows, "ts", [*CHANNELS, "k"], "30min", counts=False), "bin", TRAIN_END, VAL_END)


@query(f"WITH {_PANEL} SELECT bin, round(value, 6) AS value, n_obs_value FROM panel")
def panel_median(spark, sf_dir):
    return six(panel(spark, sf_dir), "value")


@query("""WITH o AS (SELECT epoch_us(date_trunc('day', min(ts))) AS o FROM events),
e AS (SELECT o + CAST(ceil((epoch_us(ts) - o) / 25200000000.0) AS bigint) * 25200000000 AS us, value FROM events, o),
b AS (SELECT us, avg(value) AS value, count(value) AS n FROM e GROUP BY 1),
s AS (SELECT unnest(generate_series(min(us), max(us), 25200000000)) AS us FROM b)
SELECT make_timestamp(us) AS bin, round(value, 6) AS value, coalesce(n, 0) AS n_obs_value FROM s LEFT JOIN b USING (us)""")
def panel_mean_7h(spark, sf_dir):
    return six(resample.resample(events(spark, sf_dir), "ts", ["value"], "7h", "mean"), "value")


@query(f"WITH {_WIDE} SELECT bin, {', '.join(f'round({c}, 6) AS {c}' for c in (*CHANNELS, 'k'))}, split FROM wide")
def panel_channels(spark, sf_dir):
    return six(wide(spark, sf_dir), *CHANNELS, "k")


@query("""SELECT event_id, ts, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def dedup_keep_first(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", "ts", "user_id", F.date_trunc("hour", "ts").alias("hour"))
    return keep_first(rows, ["user_id", "hour"], ["ts", "event_id"]).select("event_id", "ts", "user_id")


@query("""SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_type NOT IN ('error', 'view') OR event_type IS NULL GROUP BY 1""")
def qc_row_filter(spark, sf_dir):
    rows = quality_flags.drop_flagged(events(spark, sf_dir), "event_type", ["error", "view"])
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""WITH m AS (SELECT doc_id, try_cast(source AS double) AS a, try_cast(regexp_replace(source, '[a-z]+', '') AS double) AS b, nullif(trim(lang, ' '), '') AS f, try_cast(lang AS timestamp) AS t FROM documents)
SELECT f, count(a) AS n_bad, count(t) AS n_time, sum(CASE WHEN f IS NULL OR f NOT IN ('de', 'fr') THEN CAST(b AS bigint) END) AS masked FROM m GROUP BY 1""")
def coerce_and_mask(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(S.to_number(F.col("source")).alias("a"), S.to_number(F.regexp_replace("source", "[a-z]+", "")).alias("b"), S.flag(F.col("lang")).alias("f"), S.parse_time(F.col("lang")).alias("t"))
    masked = quality_flags.mask_flagged(rows, {"b": "f"}, ["de", "fr"])
    return masked.groupBy("f").agg(F.count("a").alias("n_bad"), F.count("t").alias("n_time"), F.sum(F.col("b").cast("long")).alias("masked"))


# -- calendar -----------------------------------------------------------------------------------------------------

_AUDIT = """o AS (SELECT CAST(o_orderdate AS date) AS d FROM orders WHERE o_orderpriority = '1-URGENT'),
f AS (SELECT date_trunc('month', d) AS m, count(DISTINCT d) AS n FROM o GROUP BY 1),
c AS (SELECT unnest(generate_series(CAST(min(m) AS timestamp), CAST(max(m) AS timestamp), interval '1 month')) AS m FROM f),
audit AS (SELECT CAST(year(c.m) AS int) AS year, CAST(month(c.m) AS int) AS month, strftime(c.m, '%Y-%m') AS year_month, CAST(day(last_day(c.m)) AS int) AS n_days_required,
CAST(coalesce(f.n, 0) AS int) AS n_days_with_data, CAST(0.7 AS double) AS p, coalesce(f.n, 0) / CAST(day(last_day(c.m)) AS double) AS coverage FROM c LEFT JOIN f ON c.m = CAST(f.m AS timestamp))"""


def _urgent(spark, sf_dir):
    """All orders, the other priorities taken for quality flags that exclude a row."""
    return quality_flags.drop_flagged(table(spark, sf_dir, "orders"), "o_orderpriority", ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@query(f"WITH {_AUDIT} SELECT year, month, year_month, n_days_required, n_days_with_data, p, round(coverage, 6) AS coverage, coverage >= p AS passes FROM audit")
def month_audit(spark, sf_dir):
    return six(calendar.month_audit(_urgent(spark, sf_dir), "o_orderdate", 0.7), "coverage")


@query(f"""WITH {_AUDIT} SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' AND EXISTS (SELECT 1 FROM audit WHERE coverage >= p AND audit.year = year(o_orderdate) AND audit.month = month(o_orderdate))""")
def months_semi_join(spark, sf_dir):
    rows = _urgent(spark, sf_dir)
    return calendar.keep_passing(rows, "o_orderdate", calendar.month_audit(rows, "o_orderdate", 0.7)).select("o_orderkey", "o_orderdate")


# -- outliers -----------------------------------------------------------------------------------------------------

_DAILY = "daily AS (SELECT CAST(o_orderdate AS date) AS day, quantile_cont(o_totalprice, 0.5) AS m FROM orders GROUP BY 1)"
_MONTHS = """g AS (SELECT month(day) AS mon, count(*) AS n, quantile_cont(m, 0.25) AS q1, quantile_cont(m, 0.75) AS q3, min(m) AS lo, max(m) AS hi FROM daily GROUP BY 1),
tukey AS (SELECT day, m, n >= 10 AND (m < CASE WHEN q3 > q1 THEN q1 - 1.5 * (q3 - q1) ELSE lo END OR m > CASE WHEN q3 > q1 THEN q3 + 1.5 * (q3 - q1) ELSE hi END) AS potential,
n >= 10 AND (m < CASE WHEN q3 > q1 THEN q1 - 3.0 * (q3 - q1) ELSE lo END OR m > CASE WHEN q3 > q1 THEN q3 + 3.0 * (q3 - q1) ELSE hi END) AS possible FROM daily JOIN g ON month(day) = mon)"""


@query(f"WITH {_DAILY} SELECT day, round(m, 6) AS daily_median FROM daily")
def daily_median(spark, sf_dir):
    return six(outliers.daily_median(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice"), "daily_median")


@query(f"WITH {_DAILY}, {_MONTHS} SELECT day, round(m, 6) AS daily_median, potential, possible FROM tukey")
def month_tukey(spark, sf_dir):
    return six(outliers.month_tukey(outliers.daily_median(table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice")), "daily_median")


@query(f"WITH {_DAILY}, {_MONTHS} SELECT potential AS on_flagged_day, count(*) AS n FROM orders JOIN tukey ON CAST(o_orderdate AS date) = day GROUP BY 1")
def day_flag_to_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    daily = outliers.month_tukey(outliers.daily_median(rows, "o_orderdate", "o_totalprice"))
    return outliers.day_flag_to_rows(rows, "o_orderdate", daily, "potential", "on_flagged_day").groupBy("on_flagged_day").agg(F.count("*").alias("n"))


_FENCES = "q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"


@query(f"WITH {_FENCES} SELECT event_id, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS tukey_potential, value < q1 - 3.0 * (q3 - q1) OR value > q3 + 3.0 * (q3 - q1) AS tukey_possible FROM events, q")
def global_tukey(spark, sf_dir):
    return outliers.global_tukey(events(spark, sf_dir), "value").select("event_id", "tukey_potential", "tukey_possible")


@query(f"WITH {_FENCES} SELECT event_id, round(least(greatest(value, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)), 6) AS winsorised FROM events, q")
def winsorise(spark, sf_dir):
    return six(outliers.winsorised(events(spark, sf_dir), "value").select("event_id", "winsorised"), "winsorised")


_HAMPEL = """h1 AS (SELECT *, CASE WHEN count(value) OVER f >= 12 THEN quantile_cont(value, 0.5) OVER f END AS med FROM events WINDOW f AS (ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND 24 FOLLOWING)),
h2 AS (SELECT *, CASE WHEN count(abs(value - med)) OVER f >= 12 THEN quantile_cont(abs(value - med), 0.5) OVER f END AS mad FROM h1 WINDOW f AS (ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND 24 FOLLOWING)),
hampel AS (SELECT *, coalesce(mad > 1e-12 AND abs(value - med) > 3.0 * 1.4826 * mad, false) AS spike FROM h2)"""


@query(f"WITH {_HAMPEL} SELECT event_id, round(med, 6) AS rolling_median, round(mad, 6) AS rolling_mad, spike FROM hampel")
def hampel(spark, sf_dir):
    rows = outliers.hampel(events(spark, sf_dir).select("event_id", "ts", "value"), "ts", ["event_id"], "value")
    return six(rows.select("event_id", "rolling_median", "rolling_mad", "spike"), "rolling_median", "rolling_mad")


def _wide_hampel(width: int) -> str:
    before, after = width - 1 - (width - 1) // 2, (width - 1) // 2
    f = f"WINDOW f AS (ORDER BY ts, event_id ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    return f"""h1 AS (SELECT *, CASE WHEN count(value) OVER f >= {max(3, width // 4)} THEN quantile_cont(value, 0.5) OVER f END AS med FROM events {f}),
h2 AS (SELECT *, CASE WHEN count(abs(value - med)) OVER f >= {max(3, width // 4)} THEN quantile_cont(abs(value - med), 0.5) OVER f END AS mad FROM h1 {f})
SELECT event_id, round(med, 6) AS rolling_median, round(mad, 6) AS rolling_mad, coalesce(mad > 1e-12 AND abs(value - med) > 3.0 * 1.4826 * mad, false) AS spike FROM h2"""


@query(f"WITH {_wide_hampel(8641)}")
def hampel_wide(spark, sf_dir):
    """Frames of a day at ten seconds."""
    rows = outliers.hampel(events(spark, sf_dir).select("event_id", "ts", "value"), "ts", ["event_id"], "value", 8641)
    return six(rows.select("event_id", "rolling_median", "rolling_mad", "spike"), "rolling_median", "rolling_mad")


_LABELS = f"""{_HAMPEL}, {_FENCES},
daily AS (SELECT CAST(ts AS date) AS day, quantile_cont(value, 0.5) AS m FROM events GROUP BY 1), {_MONTHS},
labels_ AS (SELECT h.event_id, h.ts, h.value, h.spike, t.potential AS monthly_potential, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS tp, value < q1 - 3.0 * (q3 - q1) OR value > q3 + 3.0 * (q3 - q1) AS tq
FROM hampel h CROSS JOIN q JOIN tukey t ON CAST(h.ts AS date) = t.day)"""


def labelled(spark, sf_dir):
    return outliers.labelled(events(spark, sf_dir).select("event_id", "ts", "value"), "ts", ["event_id"], "value")


@query(f"""WITH {_LABELS} SELECT count(*) AS n_rows, count(*) FILTER (spike) AS n_spike, count(*) FILTER (tp) AS n_tukey_potential, count(*) FILTER (tq) AS n_tukey_possible, count(*) FILTER (monthly_potential) AS n_monthly_potential,
count(*) FILTER (spike AND monthly_potential) AS n_conservative, CAST(count(*) FILTER (NOT spike) AS double) AS weight_sum, CAST(count(*) FILTER (NOT (spike AND monthly_potential)) AS double) AS weight_conservative_sum FROM labels_""")
def label_summary(spark, sf_dir):
    return outliers.label_summary(labelled(spark, sf_dir))


@query(f"""WITH {_HAMPEL}, {_PANEL}, r AS (SELECT {_BIN} AS bin, avg(CASE WHEN spike THEN 0.0 ELSE 1.0 END) AS w FROM hampel GROUP BY 1) SELECT panel.bin, round(panel.value, 6) AS value, n_obs_value, round(r.w, 6) AS weight_resampled FROM panel LEFT JOIN r USING (bin)""")
def panel_with_weights(spark, sf_dir):
    rows = outliers.hampel(events(spark, sf_dir).select("event_id", "ts", "value"), "ts", ["event_id"], "value").withColumn("weight", S.weight_of(F.col("spike")))
    return six(resample.with_weights(panel(spark, sf_dir), resample.resample_weights(rows, "ts", ["weight"], "30min")), "value", "weight_resampled")


# -- splits and scalers -------------------------------------------------------------------------------------------


@query(f"WITH {_WIDE} SELECT split, count(*) AS n_rows, min(bin) AS first, max(bin) AS last FROM wide GROUP BY 1")
def split_manifest(spark, sf_dir):
    return splits.split_manifest(wide(spark, sf_dir), "bin")


_SCALER = "sc AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, avg({c}) AS mean, CASE WHEN stddev_pop({c}) < 1e-8 THEN 1.0 ELSE stddev_pop({c}) END AS std FROM wide WHERE split = 'train'" for c in (*CHANNELS, "k")) + ")"


@query(f"WITH {_WIDE}, {_SCALER} SELECT name, n, round(mean, 6) AS mean, round(std, 6) AS std FROM sc")
def scaler_fit(spark, sf_dir):
    fitted = splits.fit_scaler(wide(spark, sf_dir).where("split = 'train'"), [*CHANNELS, "k"])
    return six(fitted.select(F.explode("scaler").alias("name", "s")).select("name", "s.n", "s.mean", "s.std"), "mean", "std")


@query(f"WITH {_WIDE}, {_SCALER}, m AS (SELECT mean, std FROM sc WHERE name = 'k') SELECT bin, round((k - mean) / std, 6) AS k_z, round(k, 6) AS k FROM wide, m")
def scaler_apply(spark, sf_dir):
    rows = wide(spark, sf_dir)
    scaler = splits.fit_scaler(rows.where("split = 'train'"), ["k"])
    there = splits.apply_scaler(rows, scaler, ["k"]).drop("k")
    return six(splits.apply_scaler(there, scaler, ["k"], inverse=True).select("bin", "k_z", "k"), "k_z", "k")


# -- exploration --------------------------------------------------------------------------------------------------

_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(f"WITH {_WIDE} " + " UNION ALL ".join(f"SELECT split, '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing FROM wide GROUP BY 1" for c in (*CHANNELS, "k")))
def missing_rates(spark, sf_dir):
    return six(stats.missing_rates(wide(spark, sf_dir), [*CHANNELS, "k"], ["split"]), "missing")


@query(f"WITH {_WIDE} " + " UNION ALL ".join(f"SELECT split, '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM wide GROUP BY 1" for c in (*CHANNELS, "k")))
def describe(spark, sf_dir):
    return six(stats.describe(wide(spark, sf_dir), [*CHANNELS, "k"], ["split"]), "mean", "std", "min", "q25", "q50", "q75", "max")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_LINE) for b in _LINE[i + 1 :]))
def pearson(spark, sf_dir):
    return six(stats.pearson(table(spark, sf_dir, "lineitem"), _LINE), "r")


@query(" UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, (SELECT round(corr(ra, rb), 6) FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS ra, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS rb FROM lineitem WHERE {a} IS NOT NULL AND {b} IS NOT NULL)) AS r"""
    for i, a in enumerate(_LINE) for b in _LINE[i + 1 :]
))
def spearman(spark, sf_dir):
    return six(stats.spearman(table(spark, sf_dir, "lineitem"), _LINE), "r")


@query(f"WITH {_WIDE} SELECT count(*) AS n_rows, count(*) FILTER ({' AND '.join(f'{c} IS NOT NULL' for c in CHANNELS)}) AS n_complete FROM wide")
def complete_cases(spark, sf_dir):
    return stats.complete_cases(wide(spark, sf_dir), CHANNELS)


@query("""WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT CAST(least(floor((value - lo) / (hi - lo) * 80) + 1, 80) AS int) AS bucket, count(*) AS n FROM events, r GROUP BY 1)
SELECT CAST(i AS int) AS bucket, round(lo + (i - 1) * ((hi - lo) / 80), 6) AS low, round(lo + i * ((hi - lo) / 80), 6) AS high, coalesce(n, 0) AS n FROM r, range(1, 81) t(i) LEFT JOIN b ON b.bucket = i""")
def histogram(spark, sf_dir):
    return six(stats.histogram(events(spark, sf_dir), "value"), "low", "high")


# -- windows ------------------------------------------------------------------------------------------------------

SETTINGS = windows.WindowSettings()
_LAST, _H, _P = SETTINGS.context - 1, SETTINGS.shift, SETTINGS.future
_Z = f"{_WIDE}, {_SCALER}, z AS (SELECT wide.bin, wide.split, {', '.join(f'({c} - s_{c}.mean) / s_{c}.std AS {c}' for c in (*CHANNELS, 'k'))} FROM wide, {', '.join(f'''(SELECT mean, std FROM sc WHERE name = '{c}') AS s_{c}''' for c in (*CHANNELS, 'k'))})"
_WINDOWS = f"""{_Z}, i AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY bin) - 1 AS r FROM z),
n AS (SELECT split, count(*) AS n FROM i GROUP BY 1),
long_ AS (SELECT a.split, a.r - {_LAST} AS window_id, f.r - a.r - {_H + 1} AS step, f.bin AS ts, f.k AS y, a.k AS end_value, a.bin AS context_end FROM i a JOIN n ON a.split = n.split
JOIN i f ON f.split = a.split AND f.r BETWEEN a.r + {_H + 1} AND a.r + {_H + _P} WHERE a.r >= {_LAST} AND (a.r - {_LAST}) % {SETTINGS.stride} = 0 AND a.r - {_LAST} <= n.n - {_LAST + 1 + _H + _P}),
win AS (SELECT * FROM long_ WHERE (split, window_id) IN (SELECT (split, window_id) FROM long_ WHERE step = 0 AND y IS NOT NULL))"""


def scaled(spark, sf_dir):
    rows = wide(spark, sf_dir)
    columns = [*CHANNELS, "k"]
    z = splits.apply_scaler(rows, splits.fit_scaler(rows.where("split = 'train'"), columns), columns)
    return z.select("bin", "split", *(F.col(f"{c}_z").alias(c) for c in columns))


def window_rows(spark, sf_dir):
    return windows.sliding(scaled(spark, sf_dir), "bin", CHANNELS, "k", SETTINGS)


def long_rows(spark, sf_dir):
    return windows.long_form(window_rows(spark, sf_dir))


@query(f"WITH {_WINDOWS} SELECT split, window_id, CAST(step AS int) AS step, ts, round(y, 6) AS y, round(end_value, 6) AS end_value FROM win")
def windows_long(spark, sf_dir):
    return six(long_rows(spark, sf_dir).select("split", "window_id", "step", "ts", "y", "end_value"), "y", "end_value")


@query(f"""WITH {_WINDOWS}, c AS (SELECT w.split, w.window_id, sum(coalesce(x.click, 0)) AS click, sum(coalesce(x.view, 0)) AS view, count(x.k) AS k_valid, min(x.bin) AS first FROM (SELECT DISTINCT split, window_id FROM win) w JOIN i x ON x.split = w.split AND x.r BETWEEN w.window_id AND w.window_id + {_LAST} GROUP BY 1, 2)
SELECT split, window_id, round(click, 5) AS click, round(view, 5) AS view, k_valid FROM c""")
def windows_context(spark, sf_dir):
    total = lambda i: F.round(F.aggregate(F.transform("context", lambda x: F.coalesce(x[f"f{i}"], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x), 5) + F.lit(0.0)
    valid = F.size(F.filter("context", lambda x: x["y"].isNotNull())).cast("long")
    return window_rows(spark, sf_dir).select("split", "window_id", total(CHANNELS.index("click")).alias("click"), total(CHANNELS.index("view")).alias("view"), valid.alias("k_valid"))


@query("""WITH r AS (SELECT ts, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS r, epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) AS g FROM events),
m AS (SELECT CAST(floor(quantile_cont(g, 0.5)) AS bigint) AS step FROM r WHERE g > 0),
w AS (SELECT r AS e, max(g) OVER (ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS g, count(*) OVER () AS n FROM r)
SELECT count(*) AS n_windows FROM w, m WHERE e >= 3 AND e - 3 <= n - 4 - 2 AND g <= step * 4.0""")
def window_gaps(spark, sf_dir):
    s = windows.WindowSettings(context=4, shift=0, future=2, stride=1, max_gap=4.0)
    found = windows.sliding(events(spark, sf_dir), "ts", ["value"], "value", s, keys=(), tie=("event_id",))
    return found.agg(F.count("*").alias("n_windows"))


@query(f"""WITH {_Z}, i AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY bin) - 1 AS r, count(*) OVER (PARTITION BY split) AS n FROM z),
c AS (SELECT s.split, s.r, avg(({' + '.join(f'CASE WHEN x.{c} IS NULL THEN 0.0 ELSE 1.0 END' for c in CHANNELS)}) / 5) FILTER (x.r <= s.r + {_LAST}) AS v, max(CASE WHEN x.k IS NULL THEN 0.0 ELSE 1.0 END) FILTER (x.r = s.r + {_LAST + _H + 1}) AS t
FROM i s JOIN i x ON x.split = s.split AND x.r BETWEEN s.r AND s.r + {_LAST + _H + 1} WHERE s.r + {_LAST + 1 + _H + _P} <= s.n GROUP BY 1, 2)
SELECT split, count(*) AS n_windows, round(avg(v), 6) AS context_valid, round(avg(t), 6) AS target_valid FROM c GROUP BY 1""")
def window_summary(spark, sf_dir):
    """Of windows that keep missing targets."""
    found = windows.sliding(scaled(spark, sf_dir), "bin", CHANNELS, "k", windows.WindowSettings(skip_null_target=False))
    return six(windows.window_summary(found, len(CHANNELS)), "context_valid", "target_valid")


_DAILY_WINDOWS = windows.WindowSettings(context=24, shift=2, future=12, stride=48, max_gap=None, skip_null_target=False)


@query(f"""WITH {_Z}, i AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY bin) - 1 AS r FROM z), n AS (SELECT split, count(*) AS n FROM i GROUP BY 1),
s AS (SELECT split, unnest(range(0, n - 24 - 2 - 12 + 1, 48)) AS window_id FROM n)
SELECT s.split, s.window_id, max(x.bin) FILTER (x.r = s.window_id + 23) AS context_end, round(sum(coalesce(x.view, 0)) FILTER (x.r < s.window_id + 24), 5) AS view, round(sum(coalesce(x.k, 0)) FILTER (x.r >= s.window_id + 26), 5) AS k, count(x.k) FILTER (x.r >= s.window_id + 26) AS k_valid
FROM s JOIN i x ON x.split = s.split AND x.r BETWEEN s.window_id AND s.window_id + 37 GROUP BY 1, 2""")
def windows_strided(spark, sf_dir):
    """A window a day: work in proportion to the windows, not to the rows."""
    found = windows.sliding(scaled(spark, sf_dir), "bin", CHANNELS, "k", _DAILY_WINDOWS)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 5) + F.lit(0.0)
    view, k = F.transform("context", lambda x: x[f"f{CHANNELS.index('view')}"]), F.transform("future", lambda x: x["y"])
    return found.select("split", "window_id", "context_end", total(view).alias("view"), total(k).alias("k"), F.size(F.array_compact(k)).cast("long").alias("k_valid"))


_NULL_KEYS = "g AS (SELECT event_id, ts, value, CASE WHEN event_type NOT IN ('error', 'view') THEN event_type END AS kind FROM events)"


def null_keys(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "ts", "value", F.when(~F.col("event_type").isin("error", "view"), F.col("event_type")).alias("kind"))


@query(f"""WITH {_NULL_KEYS}, q AS (SELECT kind, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS low, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, max(value) AS high FROM g GROUP BY 1)
SELECT kind, n, round(mean, 6) AS mean, round(std, 6) AS std, round(low, 6) AS low, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, round(high, 6) AS high,
round(CASE WHEN q75 > q25 THEN q25 - 1.5 * (q75 - q25) ELSE low END, 6) AS inner_low, round(CASE WHEN q75 > q25 THEN q75 + 3.0 * (q75 - q25) ELSE high END, 6) AS outer_high FROM q""")
def describe_null_group(spark, sf_dir):
    """Descriptions and fences by a key that is NULL for some rows: these are a group like others."""
    rows = null_keys(spark, sf_dir)
    found = stats.describe(rows, ["value"], ["kind"]).select("kind", "n", "mean", "std", F.col("min").alias("low"), "q25", "q50", "q75", F.col("max").alias("high"))
    fences = outliers.fences(rows, "value", ["kind"]).select("kind", "inner_low", "outer_high")
    return six(join_on(found, fences, ["kind"]), "mean", "std", "low", "q25", "q50", "q75", "high", "inner_low", "outer_high")


@query(f"""WITH {_NULL_KEYS}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY kind) AS n FROM g)
SELECT s.kind, s.r AS window_id, max(x.ts) FILTER (x.r = s.r + 9) AS context_end, round(sum(x.value) FILTER (x.r < s.r + 10), 5) AS total, max(x.value) FILTER (x.r = s.r + 10) AS y
FROM r s JOIN r x ON x.kind IS NOT DISTINCT FROM s.kind AND x.r BETWEEN s.r AND s.r + 10 WHERE s.r % 5 = 0 AND s.r + 11 <= s.n GROUP BY 1, 2""")
def windows_null_series(spark, sf_dir):
    """Windows of series, one of which has NULL as its key."""
    s = windows.WindowSettings(context=10, future=1, stride=5, max_gap=None, skip_null_target=False)
    found = windows.sliding(null_keys(spark, sf_dir), "ts", ["value"], "value", s, keys=("kind",), tie=("event_id",))
    total = F.aggregate(F.transform("context", lambda x: F.coalesce(x["y"], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    return found.select("kind", "window_id", "context_end", F.round(total, 5).alias("total"), F.col("future")[0]["y"].alias("y"))


@query("SELECT vec_id, CAST(p AS int) AS patch, round(list_sum(list_transform(embedding[p * 16 + 1 : p * 16 + 16], lambda x: CAST(x AS double))), 6) AS total FROM embeddings, range(0, 4) t(p)")
def patches(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", windows.folded(F.col("embedding").cast("array<double>"), 16).alias("p"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return six(rows.select("vec_id", F.posexplode("p").alias("patch", "v")).select("vec_id", "patch", total.alias("total")), "total")


# -- forecasts ----------------------------------------------------------------------------------------------------

_FORECAST = f"{_WINDOWS}, fc AS (SELECT split, window_id, step, y, end_value AS y_hat, end_value, (CAST(floor(window_id / 3) AS bigint) % 3) / 2.0 AS w FROM win)"
_OK = "y IS NOT NULL AND y_hat IS NOT NULL"
_MODEL = "y * 0.8 + 0.05 * (step % 5) - 0.1"


def forecast(spark, sf_dir):
    """Persistence in long form; weights 0, 0.5 and 1 by turns."""
    return metrics.persistence_baseline(long_rows(spark, sf_dir)).withColumn("w", (F.floor(F.col("window_id") / 3) % 3) / 2.0)


@query(f"""WITH {_WINDOWS}, b AS (SELECT avg(y) AS m FROM win WHERE split = 'train')
SELECT split, 'mean' AS method, round(sqrt(avg((y - m) * (y - m))), 6) AS rmse, round(avg(abs(y - m)), 6) AS mae, count(*) AS n FROM win, b WHERE y IS NOT NULL AND split <> 'train' GROUP BY 1
UNION ALL SELECT split, 'persistence' AS method, round(sqrt(avg((y - end_value) * (y - end_value))), 6) AS rmse, round(avg(abs(y - end_value)), 6) AS mae, count(*) AS n FROM win WHERE y IS NOT NULL AND end_value IS NOT NULL AND split <> 'train' GROUP BY 1""")
def baselines(spark, sf_dir):
    return six(pipelines.baseline_report(long_rows(spark, sf_dir)), "rmse", "mae")


@query(f"WITH {_FORECAST} SELECT split, round(sqrt(sum(w * (y - y_hat) * (y - y_hat)) / sum(w)), 6) AS rmse, round(sum(w * abs(y - y_hat)) / sum(w), 6) AS mae, round(sum(w * (y - y_hat)) / sum(w), 6) AS bias, count(*) AS n FROM fc WHERE {_OK} AND w > 0 GROUP BY 1")
def weighted_errors(spark, sf_dir):
    return six(metrics.weighted_errors(forecast(spark, sf_dir), ["split"]), "rmse", "mae", "bias")


@query(f"WITH {_FORECAST} SELECT CAST(step AS int) AS step, round(sqrt(avg((y - y_hat) * (y - y_hat))), 6) AS rmse, round(avg(abs(y - y_hat)), 6) AS mae, count(*) AS n FROM fc WHERE {_OK} GROUP BY 1")
def errors_per_step(spark, sf_dir):
    return six(metrics.per_step(forecast(spark, sf_dir)), "rmse", "mae")


@query(f"WITH {_FORECAST} SELECT CAST(floor(step / 4) AS int) AS block, round(sqrt(avg((y - y_hat) * (y - y_hat))), 6) AS rmse, round(avg(abs(y - y_hat)), 6) AS mae, count(*) AS n FROM fc WHERE {_OK} GROUP BY 1")
def errors_per_block(spark, sf_dir):
    return six(metrics.per_block(forecast(spark, sf_dir), 4), "rmse", "mae")


@query(f"WITH {_FORECAST} SELECT split, window_id, count(*) AS n_valid FROM fc WHERE {_OK} GROUP BY 1, 2 ORDER BY n_valid DESC, split, window_id LIMIT 3")
def top_windows(spark, sf_dir):
    return metrics.top_windows(forecast(spark, sf_dir), window=["split", "window_id"])


@query("""WITH r AS (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS r, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS g
FROM (SELECT * FROM events UNION ALL SELECT event_id, timestamp '2020-01-01' + to_hours(CAST(event_id AS int)), user_id, 'hourly', value, props FROM events WHERE event_id < 500)),
m AS (SELECT event_type, CAST(floor(quantile_cont(g, 0.5)) AS bigint) AS step FROM r WHERE g > 0 GROUP BY 1),
w AS (SELECT event_type, r AS e, max(g) OVER (PARTITION BY event_type ORDER BY r ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS g, count(*) OVER (PARTITION BY event_type) AS n FROM r)
SELECT event_type, any_value(step) AS step, count(*) FILTER (e >= 3 AND e - 3 <= n - 4 - 2 AND g <= step * 4.0) AS n_windows FROM w JOIN m USING (event_type) GROUP BY 1""")
def window_gaps_by_series(spark, sf_dir):
    """Series of different cadences side by side, each judged by its own step."""
    rows = events(spark, sf_dir).select("event_id", "ts", "event_type", "value")
    hourly = rows.where("event_id < 500").select("event_id", (F.lit("2020-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("event_id").cast("int"))).alias("ts"), F.lit("hourly").alias("event_type"), "value")
    both = rows.unionByName(hourly)
    s = windows.WindowSettings(context=4, shift=0, future=2, stride=1, max_gap=4.0, skip_null_target=False)
    found = windows.sliding(both, "ts", ["value"], "value", s, keys=("event_type",), tie=("event_id",))
    counts = found.groupBy("event_type").agg(F.count("*").alias("n_windows"))
    steps = windows.median_step(both, "ts", ["event_id"], ["event_type"])
    return steps.join(counts, "event_type", "left").select("event_type", "step", F.coalesce("n_windows", F.lit(0)).alias("n_windows"))


@query(f"WITH {_FORECAST}, m AS (SELECT *, {_MODEL} AS p FROM fc), d AS (SELECT *, y - CASE WHEN step = 0 THEN end_value ELSE lag(y) OVER v END AS dy, p - CASE WHEN step = 0 THEN end_value ELSE lag(p) OVER v END AS dh FROM m WINDOW v AS (PARTITION BY split, window_id ORDER BY step)), s AS (SELECT 'none' AS kind, NULL::double AS level, NULL::double AS difference, NULL::double AS rho UNION ALL SELECT 'mae' AS kind, avg(abs(p - y)) AS level, avg(abs(dh - dy)) FILTER (dy IS NOT NULL AND dh IS NOT NULL) AS difference, avg(CASE WHEN sign(dy) <> sign(dh) THEN 1.0 ELSE 0.0 END) FILTER (dy IS NOT NULL AND dh IS NOT NULL) AS rho FROM d WHERE y IS NOT NULL AND p IS NOT NULL) SELECT kind, round(level, 6) AS level, round(difference, 6) AS difference, round(rho, 6) AS rho, round(rho * level + (1 - rho) * difference, 6) AS total FROM s")
def difference_alignment_edges(spark, sf_dir):
    """Absolute errors without weights; no row of positive weight at all."""
    rows = forecast(spark, sf_dir).withColumn("y_hat", F.expr(_MODEL))
    none = metrics.tdalign(rows.withColumn("w", F.lit(0.0)), ["split", "window_id"]).withColumn("kind", F.lit("none"))
    plain = metrics.tdalign(rows, ["split", "window_id"], loss="mae", weighted=False).withColumn("kind", F.lit("mae"))
    return six(none.unionByName(plain).select("kind", "level", "difference", "rho", "total"), "level", "difference", "rho", "total")


_BLOCKS = f"""{_FORECAST}, e AS (SELECT split, window_id, CAST(floor(step / 4) AS int) AS block, CASE WHEN coalesce(sum(w) FILTER ({_OK} AND w > 0), 0) > 1e-12 THEN sum(w * (y - y_hat)) FILTER ({_OK} AND w > 0) / sum(w) FILTER ({_OK} AND w > 0) END AS own FROM fc GROUP BY 1, 2, 3),
bias AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY split, window_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS bias FROM e)"""


@query(f"WITH {_BLOCKS} SELECT split, window_id, block, round(own, 6) + 0.0 AS own, round(bias, 6) + 0.0 AS bias FROM bias")
def block_bias(spark, sf_dir):
    return six(calibration.block_bias(forecast(spark, sf_dir), 4, ["split", "window_id"]), "own", "bias")


@query(f"""WITH {_BLOCKS}, c AS (SELECT fc.*, y_hat + bias AS y_cal FROM fc JOIN bias b ON b.split = fc.split AND b.window_id = fc.window_id AND b.block = CAST(floor(fc.step / 4) AS int)),
k AS (SELECT 'raw' AS kind, y, y_hat AS p, w FROM c UNION ALL SELECT 'calibrated' AS kind, y, y_cal AS p, w FROM c)
SELECT kind, round(sqrt(sum(w * (y - p) * (y - p)) / sum(w)), 6) AS rmse, round(sum(w * abs(y - p)) / sum(w), 6) AS mae, round(sum(w * (y - p)) / sum(w), 6) AS bias, count(*) AS n FROM k WHERE y IS NOT NULL AND p IS NOT NULL AND w > 0 GROUP BY 1""")
def calibration_report(spark, sf_dir):
    return six(calibration.calibration_report(forecast(spark, sf_dir), 4, ["split", "window_id"]), "rmse", "mae", "bias")


@query(f"WITH {_BLOCKS} SELECT split, window_id, block, round(bias, 6) + 0.0 AS bias FROM bias WHERE (split, window_id, block) IN (SELECT (split, window_id, CAST(floor(step / 4) AS int)) FROM fc WHERE {_OK}) ORDER BY split, window_id, block LIMIT 70")
def first_blocks(spark, sf_dir):
    return six(calibration.first_blocks(forecast(spark, sf_dir), 4, 70, ["split", "window_id"]).select("split", "window_id", "block", "bias"), "bias")


@query(f"""WITH {_FORECAST}, m AS (SELECT *, {_MODEL} AS p FROM fc), d AS (SELECT *, y - CASE WHEN step = 0 THEN end_value ELSE lag(y) OVER v END AS dy, p - CASE WHEN step = 0 THEN end_value ELSE lag(p) OVER v END AS dh FROM m WINDOW v AS (PARTITION BY split, window_id ORDER BY step)),
s AS (SELECT sum(w * (p - y) * (p - y)) / sum(w) AS level, sum(w * (dh - dy) * (dh - dy)) FILTER (dy IS NOT NULL AND dh IS NOT NULL) / sum(w) FILTER (dy IS NOT NULL AND dh IS NOT NULL) AS difference, avg(CASE WHEN sign(dy) <> sign(dh) THEN 1.0 ELSE 0.0 END) FILTER (dy IS NOT NULL AND dh IS NOT NULL) AS rho FROM d WHERE y IS NOT NULL AND p IS NOT NULL AND w > 0)
SELECT round(level, 6) AS level, round(difference, 6) AS difference, round(rho, 6) AS rho, round(rho * level + (1 - rho) * difference, 6) AS total FROM s""")
def difference_alignment(spark, sf_dir):
    rows = forecast(spark, sf_dir).withColumn("y_hat", F.expr(_MODEL))
    return six(metrics.tdalign(rows, ["split", "window_id"]), "level", "difference", "rho", "total")


@query(f"WITH {_FORECAST} SELECT split, round(sum(w * (y - y_hat) * (y - y_hat)) / sum(w), 6) AS loss FROM fc WHERE {_OK} GROUP BY 1")
def weighted_mse(spark, sf_dir):
    return six(metrics.weighted_mse(forecast(spark, sf_dir), by=["split"]), "loss")


@query(f"""WITH {_FORECAST}, m AS (SELECT *, {_MODEL} - end_value AS s, y * 0.9 AS t FROM fc), r AS (SELECT sum(w * (s - (y - end_value)) * (s - (y - end_value))) / sum(w) AS a, sum(w * (s - (t - end_value)) * (s - (t - end_value))) FILTER (t IS NOT NULL) / sum(w) FILTER (t IS NOT NULL) AS b FROM m WHERE y IS NOT NULL AND s IS NOT NULL)
SELECT round(a, 6) AS supervised, round(b, 6) AS distilled, round(0.3 * a + 0.7 * b, 6) AS loss FROM r""")
def distillation(spark, sf_dir):
    rows = forecast(spark, sf_dir)
    student = rows.withColumn("y_hat", F.expr(f"{_MODEL} - end_value"))
    teacher = rows.withColumn("y_hat", F.col("y") * 0.9)
    return six(metrics.distillation(student, teacher, 0.3, residual=True, on=["split", "window_id", "step"]).select("supervised", "distilled", "loss"), "supervised", "distilled", "loss")


@query(f"WITH {_FORECAST} SELECT split, round(avg(y_hat - y), 6) AS mean_residual, round(avg(y - end_value), 6) AS mean_delta, count(*) AS n FROM fc WHERE {_OK} GROUP BY 1")
def residuals(spark, sf_dir):
    rows = metrics.delta_target(metrics.residuals(metrics.usable(forecast(spark, sf_dir))))
    return six(rows.groupBy("split").agg(F.avg("residual").alias("mean_residual"), F.avg("delta").alias("mean_delta"), F.count("*").alias("n")), "mean_residual", "mean_delta")


# -- flags, labels, provenance ------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT event_type AS flag, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) <= 3600000000 THEN 0 ELSE 1 END AS new FROM events WHERE event_type IS NOT NULL),
s AS (SELECT *, sum(new) OVER (PARTITION BY flag ORDER BY ts ROWS UNBOUNDED PRECEDING) AS span FROM f)
SELECT flag, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY flag, span""")
def flag_spans(spark, sf_dir):
    return spans.flag_spans(events(spark, sf_dir), "ts", "event_type")


@query("SELECT DISTINCT o_orderpriority AS flag FROM orders WHERE year(o_orderdate) = 1997")
def distinct_flags(spark, sf_dir):
    return spans.distinct_flags(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderpriority", 1997)


@query("SELECT year(o_orderdate)::int AS year, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders WHERE year(o_orderdate) IN (1996, 1998) GROUP BY 1")
def union_of_years(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    both = rows.where("year = 1996").unionByName(rows.where("year = 1998"))
    return both.groupBy("year").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))


@query("""SELECT o_orderkey, coalesce(nullif(replace(trim(regexp_replace(o_orderpriority, '[^0-9a-zA-Z]+', ' ', 'g'), ' '), ' ', '_'), ''), 'custom') AS slug,
CASE WHEN abs(o_totalprice / 1e7) < 0.01 AND o_totalprice <> 0 THEN printf('%.1e', o_totalprice / 1e7) ELSE printf('%.2f', o_totalprice / 1e7) END AS label,
CASE WHEN o_orderstatus = 'O' THEN 'open' WHEN o_orderstatus = 'F' THEN 'filled' ELSE o_orderstatus END AS status FROM orders""")
def labels_and_slugs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", S.slug(F.col("o_orderpriority")).alias("slug"), S.annotation(F.col("o_totalprice") / F.lit(1e7)).alias("label"), S.renamed(F.col("o_orderstatus"), {"O": "open", "F": "filled"}).alias("status"))


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL")
def fingerprints(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null")
    return rows.select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))


# -- models: no SQL, rows only ------------------------------------------------------------------------------------

MODEL_SETTINGS = windows.WindowSettings(max_gap=None)


def _predicted(spark, sf_dir, kind: str) -> DataFrame:
    """The model's forward pass from seeded weights over all windows, as changes from the end value; the student's from its own estimate."""
    c = models.ForecastConfig(channels=len(CHANNELS), horizon=MODEL_SETTINGS.future)
    weights = {"gru": models.gru_weights(c), "mlp": models.mlp_weights(c, MODEL_SETTINGS.context), "teacher": models.attention_weights(c), "student_residual": models.attention_weights(c, student=True, residual=True)}[kind]
    found = windows.sliding(scaled(spark, sf_dir), "bin", CHANNELS, "k", MODEL_SETTINGS)
    own_end = kind == "student_residual"
    return six(models.predict(found, kind, weights, c, residual=not own_end), "y_hat", *(("end_hat", "delta") if own_end else ()))


@query()
def model_gru(spark, sf_dir):
    return _predicted(spark, sf_dir, "gru")


@query()
def model_mlp(spark, sf_dir):
    return _predicted(spark, sf_dir, "mlp")


@query()
def model_teacher(spark, sf_dir):
    return _predicted(spark, sf_dir, "teacher")


@query()
def model_student(spark, sf_dir):
    return _predicted(spark, sf_dir, "student_residual")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resample, weigh by Hampel labels, window, persist, calibrate, report."""
    return calibration_report(spark, sf_dir)
