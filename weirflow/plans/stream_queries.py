"""The operators over streams of the given tables: what a stream has given out when all files are read, beside the SQL of the closed part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.plans.queries import _BIN, _BLOCKS, forecast, query, six
from weirflow.sources.scratch import fresh_folder
from weirflow.streaming.calibration import calibrated_stream
from weirflow.streaming.panel import dense_panel


def given_out(spark: SparkSession, rows: DataFrame, tag: str) -> DataFrame:
    """What a streaming frame gives out in append mode over all files that are there."""
    folder = fresh_folder(spark, tag)
    rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def own_session(spark: SparkSession) -> SparkSession:
    """A session with the settings that results hang on: keyed state sets the state store, which other queries need not have."""
    own = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(key, spark.conf.get(key))
    return own


@query(f"""WITH b AS (SELECT event_type, {_BIN} AS bin, quantile_cont(value, 0.5) AS value, count(value) AS n FROM events GROUP BY 1, 2),
c AS (SELECT event_type, min(bin) AS low, max(bin) AS high FROM b WHERE bin <= (SELECT max(ts) FROM events) - interval '2 hours' GROUP BY 1),
s AS (SELECT event_type, unnest(generate_series(low, high, interval '30 minutes')) AS bin FROM c)
SELECT s.event_type, s.bin, round(value, 6) + 0.0 AS value, coalesce(n, 0) AS n_obs_value FROM s LEFT JOIN b ON b.event_type = s.event_type AND b.bin = s.bin""")
def stream_panel(spark, sf_dir):
    """Dense panels of medians for each kind of event, up to the last bin that the watermark has closed."""
    path = f"{sf_dir}/events.parquet"
    rows = own_session(spark).readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    found = dense_panel(rows.select("event_type", "ts", "value"), "ts", ["value"], "30min", "2 hours", keys=["event_type"])
    return six(given_out(spark, found, "stream"), "value")


@query(f"""WITH {_BLOCKS}, l AS (SELECT win.split, win.window_id, win.step, win.ts, CAST(floor(win.step / 4) AS int) AS block, fc.y_hat FROM win JOIN fc ON fc.split = win.split AND fc.window_id = win.window_id AND fc.step = win.step),
o AS (SELECT split, window_id, block, min(ts) AS first FROM l GROUP BY 1, 2, 3)
SELECT l.split, l.window_id, CAST(l.step AS int) AS step, l.block, round(l.y_hat + bias, 6) + 0.0 AS y_cal FROM l JOIN o USING (split, window_id, block) JOIN bias b ON b.split = l.split AND b.window_id = l.window_id AND b.block = l.block
WHERE o.first <= (SELECT max(ts) FROM win) - interval '12 hours'""")
def stream_calibration(spark, sf_dir):
    """Calibrated forecasts of all blocks whose start the watermark has reached."""
    folder = f"{fresh_folder(spark, 'forecasts')}/rows"
    rows = forecast(spark, sf_dir).select("split", "window_id", "step", "ts", "y", "y_hat", "valid", "w")
    rows.write.parquet(folder)
    stream = own_session(spark).readStream.schema(rows.schema).parquet(folder)
    found = calibrated_stream(stream, 4, ["split", "window_id"], late="12 hours")
    return six(given_out(spark, found, "stream").select("split", "window_id", "step", "block", "y_cal"), "y_cal")


