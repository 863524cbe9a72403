"""What earlier runs left: window tables, scalers, metrics, checkpoints, fingerprints."""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.sources import npz, versions

#: Files up to this size are hashed whole, larger ones by their first mebibyte.
WHOLE = 5 << 20
PREFIX = 1 << 20
#: Bytes that are read at once.
BLOCK = 1 << 20


def scaler(spark: SparkSession, path: str) -> DataFrame:
    """A scaler's JSON (method, features {name: {mean, std}}, target {name, mean, std}) as one row with scaler: map."""
    stat = "struct<mean: double, std: double>"
    rows = spark.read.option("multiLine", True).schema(f"method string, features map<string, {stat}>, target struct<name: string, mean: double, std: double>").json(path)
    own = F.create_map("target.name", F.struct(F.col("target.mean").alias("mean"), F.col("target.std").alias("std")))
    return rows.select("method", F.map_concat("features", own).alias("scaler"), F.col("target.name").alias("target"))


def scaler_json(fitted: DataFrame, target: str, method: str = "zscore") -> str:
    """The JSON of a fitted scaler (one row)."""
    found = fitted.first()["scaler"]
    stat = lambda s: {"mean": s["mean"], "std": s["std"]}
    return json.dumps({"method": method, "features": {k: stat(v) for k, v in found.items() if k != target}, "target": {"name": target, **stat(found[target])}}, indent=2)


def any_target(df: DataFrame) -> DataFrame:
    """Window rows with y and y_valid, whichever form they have: many targets (targets, Y_z) or one (target, y_z).

    Valid is what its mask (<name>_mask; Y_mask, y_mask), if there, says and what is finite.
    """
    name = next(c for c in ("targets", "Y_z", "target", "y_z") if c in df.columns)
    many, mask = name in ("targets", "Y_z"), name.removesuffix("_z") + "_mask"
    listed = lambda c: F.col(c) if many else F.array(c)
    is_finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = F.transform(listed(name), is_finite)
    if mask in df.columns:
        valid = F.zip_with(valid, listed(mask), lambda v, m: v & F.coalesce(m, F.lit(False)))
    return df.withColumn("y", listed(name)).withColumn("y_valid", valid)


def leaderboard(spark: SparkSession, root: str, pattern: str = "*_eval_summary.json") -> DataFrame:
    """(model, resample, window, val_rmse, test_rmse) of all summaries below root, sorted; files that are no JSON are passed over."""
    # Paths end in <resample>/<split>/<window>/<run>/<file>.
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("wholetext", True).text(root).select("value", F.col("_metadata.file_path").alias("path"))
    at = F.split("path", "/")
    number = lambda *names: F.coalesce(*(F.get_json_object("value", f"$.{n}").try_cast("double") for n in names))
    model = F.regexp_extract("path", r"([A-Za-z0-9]+)_eval_summary\.json$", 1)
    rows = files.where(F.get_json_object("value", "$").isNotNull())
    return rows.select(
        F.when(F.element_at(at, -2).contains("student"), F.concat(model, F.lit("_student"))).otherwise(model).alias("model"),
        F.try_element_at(at, F.lit(-5)).alias("resample"),
        F.try_element_at(at, F.lit(-3)).alias("window"),
        number("val_rmse_chl", "val_rmse").alias("val_rmse"),
        number("test_rmse_chl", "test_rmse").alias("test_rmse"),
    ).orderBy("resample", "window", "model")


def pick_window_dir(dirs: DataFrame, name: str = "name") -> DataFrame:
    """Of the names windowed_L*_H*_P*_S* the one of least stride, then the first: one row."""
    stride = F.coalesce(F.nullif(F.regexp_extract(name, r"_S(\d+)$", 1), F.lit("")).cast("long"), F.lit(10**9).cast("long"))
    return dirs.where(F.col(name).rlike(r"^windowed_L.*_H.*_P.*_S")).withColumn("stride", stride).orderBy("stride", name).limit(1)


def relative(root: str) -> Column:
    """A file's path below root."""
    return F.regexp_replace("path", "^.*?" + re.escape(re.sub(r"^[a-z]+:/*", "", root).strip("/")) + "/", "")


def by_path(files: DataFrame, root: str, patterns: Sequence[str]) -> DataFrame:
    """Those that match one of the patterns: by name in any folder, or, if it holds a slash, by the path below root.

    * and ? stand within one name, ** for any folders.
    """
    patterns = [p if "/" in p else f"**/{p}" for p in patterns]
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    rule = "|".join("".join(parts.get(x, re.escape(x)) for x in re.split(r"(\*\*/|\*\*|\*|\?)", p)) for p in patterns)
    return files.where(relative(root).rlike(f"^(?:{rule})$"))


def fingerprints(spark: SparkSession, root: str, patterns: Sequence[str] = ("*",), limit: int = WHOLE, prefix: int = PREFIX) -> DataFrame:
    """(path, size, modified, sha256, whole, read) of files below root that match; those beyond limit by the hash of their first prefix bytes.

    Tasks read block by block, and of large files no more than the prefix; read has
    the bytes.  So files of any size can be hashed, whole ones too.
    """
    listed = by_path(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root), root, patterns).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

    def each(batches):
        for batch in batches:
            found, read = [], []
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = npz.file_system(path if "://" in path else re.sub("^file:/*", "/", path))
                digest, left, n = hashlib.sha256(), size if size <= limit else prefix, 0
                with system.open_input_file(at) as f:
                    while left and (block := f.read(min(left, BLOCK))):
                        digest.update(block)
                        left, n = left - len(block), n + len(block)
                found.append(digest.hexdigest())
                read.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array([s <= limit for s in batch.column(1).to_pylist()], pa.bool_()), pa.array(read, pa.int64())], names)

    names = ["path", "size", "modified", "sha256", "whole", "read"]
    return listed.mapInArrow(each, "path string, size long, modified timestamp, sha256 string, whole boolean, read long").orderBy("path")


def large_artifacts(spark: SparkSession, root: str, suffixes: Sequence[str] = ("npz", "pt")) -> DataFrame:
    """(path, size, modified) alone: contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("path")


def git_state(root: str) -> dict:
    """Revision, branch and whether there are changes; failures are recorded, not raised."""
    found = {}
    for key, args in (("revision", ["rev-parse", "HEAD"]), ("branch", ["rev-parse", "--abbrev-ref", "HEAD"]), ("status", ["status", "--porcelain"])):
        try:
            out = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=30, check=True).stdout.strip()
            found |= {"dirty": bool(out)} if key == "status" else {key: out}
        except (OSError, subprocess.SubprocessError) as e:
            found[f"{key}_error"] = type(e).__name__
    return found


def snapshot(spark: SparkSession, root: str, out: str, patterns: Sequence[str] = ("*",)) -> DataFrame:
    """Publishes the files' fingerprints and the state of the run as the next version in out; returns the fingerprints.

    Earlier snapshots stay (``versions.versions`` lists them); out/latest (JSON) says where the last one is.
    """
    files = fingerprints(spark, root, patterns)
    state = git_state(root)
    run = spark.createDataFrame([(json.dumps(state), spark.version)], "git string, spark string")
    entry = versions.publish({"files": files, "run": run}, out, {"root": root, "git": state}, "json")
    pointer = spark.createDataFrame([(entry["number"], f"{entry['folder']}/files", json.dumps(state))], "number long, files string, git string")
    pointer.coalesce(1).write.mode("overwrite").json(f"{out}/latest")
    return versions.read(spark, out, "files", entry["number"])
