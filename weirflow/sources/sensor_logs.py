"""Sensor logs of one CSV a year, their flag dictionary, weight tables, and the sinks between stages."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weirflow.functions.scalars import flag, parse_time, quoted, to_number, weight
from weirflow.operators.ordering import keep_first
from weirflow.operators.quality_flags import EXCLUDED, drop_flagged, mask_flagged

# The data set's column names.
TIME = "DateTime"
FEATURES = ("SpCondShallow_uS/cm", "ODOShallow_mg/L", "TempShallow_C", "pHShallow", "TurbShallow_NTU+")
TARGET = "ChlRFUShallow_RFU"
WEATHER = ("BarometricPress_kPa", "RelativeHum_%", "WindSp_km/h", "DailyRain_mm", "AirTemp_C")
LABELS = {"TurbShallow_NTU+": "TurbShallow_NTU"}
MISSING = "NA"


@dataclass(frozen=True)
class SensorSchema:
    features: tuple[str, ...] = FEATURES
    target: str = TARGET

    @property
    def values(self) -> tuple[str, ...]:
        return (*self.features, self.target)

    @property
    def flags(self) -> tuple[str, ...]:
        return tuple(f"{c}_Flag" for c in self.values)

    def describe(self) -> str:
        return "\n".join(["features:", *(f"  {c}" for c in self.features), f"target: {self.target}"])


def paths(spark: SparkSession, glob: str) -> list[str]:
    """Files that match, in order; an error if none does.  Works on any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(glob)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    files = sorted(str(f.getPath()) for f in found or [])
    if not files:
        raise FileNotFoundError(f"nothing matches {glob}")
    return files


def headers(spark: SparkSession, files: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """The files of each header, headers in the order of their first file.

    One distributed pass, a task a split, which ends after a file's first line.
    """

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    cost, most = "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(cost)
    spark.conf.set(cost, spark.conf.get(most))  # so that no split shares a task with another
    try:
        lines = spark.read.text(list(files)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
        found = lines.mapInArrow(first, "value string, path string, at long").where("at = 0").groupBy("value").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()
    finally:
        spark.conf.set(cost, before)
    by: dict[tuple[str, ...], list[str]] = {}
    for r in found:  # a row a header
        by.setdefault(tuple(next(csv.reader([r["value"].lstrip("\ufeff")]))), []).extend(r["paths"])
    return dict(sorted(((h, sorted(p)) for h, p in by.items()), key=lambda x: x[1][0]))


def _alike(spark: SparkSession, header: tuple[str, ...], files: list[str], wanted: Sequence[str] | None) -> DataFrame:
    """Files of one header in one scan, all columns text; those of wanted that they have."""
    schema = StructType([StructField(c, StringType()) for c in header])
    rows = spark.read.option("header", True).option("nullValue", MISSING).option("enforceSchema", True).schema(schema).csv(files)
    names = [c for c in schema.names if wanted is None or c in wanted]
    return rows.select(*(quoted(c) for c in names), F.col("_metadata.file_name").alias("source_file"))


def scan(spark: SparkSession, glob: str, values: Sequence[str] | None = None, require: bool = False) -> DataFrame:
    """All files as one frame: DateTime, values (double), <value>_Flag (text), source_file.

    values None takes every column.  Columns that a file lacks are NULL there; a
    value column that no file has is an error, and with require one that any
    file lacks.  Rows without a valid time go; nothing is sorted or deduplicated.
    Files of equal headers are one scan, however many they are.
    """
    wanted = None if values is None else {TIME, *values, *(f"{v}_Flag" for v in values)}
    frames = [_alike(spark, header, files, wanted) for header, files in headers(spark, paths(spark, glob)).items()]
    if values is not None:
        have = [set(f.columns) for f in frames]
        lacking = [v for v in values if not (all if require else any)(v in h for h in have)]
        if lacking:
            raise ValueError(f"value columns missing: {lacking}")
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    texts = {TIME, "source_file"}
    typed = {c: flag(quoted(c)) if c.endswith("_Flag") else to_number(quoted(c)) for c in rows.columns if c not in texts}
    return rows.withColumns({TIME: parse_time(quoted(TIME)), **typed}).where(F.col(TIME).isNotNull())


def trimmed_target(spark: SparkSession, glob: str, target: str = TARGET, codes: Sequence[str] = EXCLUDED) -> DataFrame:
    """The target's rows of good flags, one for each time: the first by file and value."""
    rows = scan(spark, glob, [target])
    rows = drop_flagged(rows, f"{target}_Flag", codes) if f"{target}_Flag" in rows.columns else rows
    return keep_first(rows, [TIME], [F.col("source_file"), quoted(target)])


def masked_series(spark: SparkSession, glob: str, values: Sequence[str] = SensorSchema().values, codes: Sequence[str] = EXCLUDED, require: bool = False) -> DataFrame:
    """All values, those of excluded flags NULL, one row for each time."""
    rows = scan(spark, glob, values, require)
    masked = mask_flagged(rows, {v: f"{v}_Flag" for v in values}, codes)
    return keep_first(masked.select(TIME, *(quoted(v) for v in values), "source_file"), [TIME], [F.col("source_file"), *(quoted(v) for v in values)])


def all_years(spark: SparkSession, glob: str) -> DataFrame:
    """Every column of every file with Year; neither sorted nor deduplicated."""
    return scan(spark, glob).withColumn("Year", F.year(TIME))


def plottable(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (TIME, "Year", "source_file") and not c.endswith("_Flag")]


def flag_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(flag, definition); a missing file gives no rows."""
    try:
        paths(spark, path)
    except FileNotFoundError:
        return spark.createDataFrame([], "flag string, definition string")
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema("flag string, definition string").csv(path)
    return rows.select(flag(F.regexp_replace("flag", "﻿", "")).alias("flag"), F.trim("definition").alias("definition")).where("flag is not null")


def weight_table(spark: SparkSession, path: str, prefix: str = "weight") -> DataFrame:
    """DateTime and all columns that begin with prefix, within [0, 1]; what is missing weighs nothing; the first row of each time."""
    rows = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    names = [c for c in rows.columns if c.startswith(prefix)]
    typed = rows.select(parse_time(quoted(TIME).cast("string")).alias(TIME), *(weight(quoted(c).try_cast("double")).alias(c) for c in names)).where(f"{TIME} is not null")
    return keep_first(typed, [TIME], [quoted(c) for c in names] or [F.lit(0)])


def write(df: DataFrame, path: str, by: Sequence[str] = (), fmt: str = "parquet") -> None:
    """The sink of all stages: Parquet (or CSV, JSON, ORC), by partition columns if any."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(path)
