"""Working files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder where the driver is the only executor; else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "weirflow-shared")


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A new path; what stands there goes when the driver ends."""
    path = f"{shared_folder(spark)}/weirflow-{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _file_system(spark, path)
    fs.delete(where, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session has gone before us
            return


def one_file(df: DataFrame, path: str, fmt: str = "csv", **options) -> str:
    """df as a single file of that very name, as logs and reports are; returns the path."""
    spark, made = df.sparkSession, f"{path}.parts"
    df.coalesce(1).write.mode("overwrite").format(fmt).options(**options).save(made)
    where, fs = _file_system(spark, made)
    part = next(str(f.getPath()) for f in fs.listStatus(where) if f.getPath().getName().startswith("part-"))
    to, _ = _file_system(spark, path)
    fs.delete(to, False)
    fs.rename(_file_system(spark, part)[0], to)
    fs.delete(where, True)
    return path
