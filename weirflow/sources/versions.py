"""Published results: numbered versions, each whole or not there, and a log that names them.

A version's frames are written to a folder of its own; the log's entry for it
is made after that, exclusively, so of two writers one takes the number and the other the next.
A write that fails leaves a folder that no entry names: readers see the version before.
Readers open a folder that never changes, so they keep what they opened, also while
newer versions come.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

LOG = "_versions"


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> str:
    where, fs = _place(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _claim(spark: SparkSession, path: str, text: str) -> bool:
    """Whether the file could be made: False if it is there."""
    where, fs = _place(spark, path)
    if fs.exists(where):
        return False
    made, _ = _place(spark, f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(made, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    # A link or rename that fails where the name is taken; the local file system's would replace it, so its own call is used there.
    if where.toUri().getScheme() in (None, "file") or fs.getScheme() == "file":
        import os

        try:
            os.link(made.toUri().getPath(), where.toUri().getPath())
        except FileExistsError:
            return False
        finally:
            fs.delete(made, False)
        return True
    taken = fs.rename(made, where)
    if not taken:
        fs.delete(made, False)
    return taken


def versions(spark: SparkSession, root: str) -> list[dict]:
    """The log's entries, the oldest first: number, folder, names and what was said about it."""
    where, fs = _place(spark, f"{root}/{LOG}")
    if not fs.exists(where):
        return []
    names = sorted(n for f in fs.listStatus(where) if re.fullmatch(r"\d{9}\.json", n := f.getPath().getName()))
    return [json.loads(_read(spark, f"{root}/{LOG}/{n}")) for n in names]


def publish(frames: dict[str, DataFrame], root: str, about: dict | None = None, fmt: str = "parquet") -> dict:
    """Writes the frames as the next version and returns its entry."""
    if not frames:
        raise ValueError("nothing to publish")
    spark = next(iter(frames.values())).sparkSession
    folder = f"{root}/data-{uuid.uuid4().hex}"
    for name, df in frames.items():
        df.write.format(fmt).save(f"{folder}/{name}")
    where, fs = _place(spark, f"{root}/{LOG}")
    fs.mkdirs(where)
    number = max((v["number"] for v in versions(spark, root)), default=0) + 1
    while True:
        entry = {"number": number, "folder": folder, "format": fmt, "schemas": {n: df.schema.jsonValue() for n, df in frames.items()}, "about": about or {}}
        if _claim(spark, f"{root}/{LOG}/{number:09d}.json", json.dumps(entry)):
            return entry
        number += 1


def read(spark: SparkSession, root: str, name: str, number: int | None = None) -> DataFrame:
    """A frame of the last version, or of the one of that number."""
    from pyspark.sql.types import StructType

    found = [v for v in versions(spark, root) if number is None or v["number"] == number]
    if not found:
        raise FileNotFoundError(f"no version{'' if number is None else f' {number}'} in {root}")
    entry = found[-1]
    return spark.read.schema(StructType.fromJson(entry["schemas"][name])).format(entry["format"]).load(f"{entry['folder']}/{name}")


def prune(spark: SparkSession, root: str, keep: int = 10) -> list[int]:
    """Removes all but the last versions, entries first, and folders that no entry names; returns the numbers that went.

    A writer that has not published yet would lose its folder: prune when none writes.
    """
    if keep < 1:
        raise ValueError("one version at least stays")
    found = versions(spark, root)
    gone = found[:-keep]
    for v in gone:
        where, fs = _place(spark, f"{root}/{LOG}/{v['number']:09d}.json")
        fs.delete(where, False)
    named = {v["folder"].rsplit("/", 1)[-1] for v in found[-keep:]}
    where, fs = _place(spark, root)
    for f in fs.listStatus(where):
        if (name := f.getPath().getName()).startswith("data-") and name not in named:
            fs.delete(f.getPath(), True)
    return [v["number"] for v in gone]
