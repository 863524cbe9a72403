"""What the operators share: shared working tables, Arrow batches, row ids, graphs."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: UTF-8 bytes of text that a Python worker takes in hand at once.
CHUNK_BYTES = 4 << 20
#: Bytes of text after which a worker hands freed memory back.
TRIM_BYTES = 16 << 20

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a session whose executors are the driver itself takes a
    temporary folder; on a cluster that is an error, as others could not read it.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "weirflow-shared")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/weirflow-{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


#: Rows, and bytes where Spark knows that bound, of an Arrow batch at most: rows here are whole texts.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session set to Arrow batches that stay small with long texts.

    The setting stays: plans read it when they run, which is after the operator has returned its lazy result.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))
    return df


def drop_written(*tables: DataFrame) -> None:
    """Remove tables that written() made and nothing reads any more."""
    for df in tables:
        if (path := getattr(df, "_written", None)) is not None:
            drop_shared(df.sparkSession, path)


def drop_shared(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            drop_shared(spark, path)
        except Exception:  # noqa: BLE001 - the session has gone before us
            return


#: Drops a query's shuffle files as soon as the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str, codec: str = "snappy", by: Sequence[str] = ()) -> DataFrame:
    """df as a table in the shared folder: read often, computed once, its lineage cut, its shuffle files dropped."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, partitionBy=list(by) or None, compression=codec)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def chunks(batches: Iterable[pa.RecordBatch], column: int, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the text column of each has about max_bytes at most (one row at least).

    Now and then, and at the end, freed memory goes back to the system.
    """
    since = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0).cast(pa.int64()))
        ends = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            since += int(ends[to - 1]) - base
            at = to
            if since >= TRIM_BYTES:
                trim()
                since = 0
    trim()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as uint8, offsets int64 from 0) of a string or binary column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def long_pieces(column: pa.Array, most: int) -> tuple[pa.Array, np.ndarray | None]:
    """(texts of about most bytes at most, pieces of each row), cut before an ASCII white space; None where no row is longer.

    A run without white space stays whole.
    """
    data, offsets = text_bytes(column)
    sizes = np.diff(offsets)
    if not len(sizes) or sizes.max() <= most:
        return column, None
    blank = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
    cuts, counts = [], np.ones(len(sizes), np.int64)
    for row in np.flatnonzero(sizes > most):
        at, end = int(offsets[row]), int(offsets[row + 1])
        while end - at > most:
            k = np.searchsorted(blank, at + most, side="right") - 1
            if k < 0 or blank[k] <= at:
                k += 1
            if k >= len(blank) or blank[k] >= end:
                break
            at = int(blank[k])
            cuts.append(at)
            counts[row] += 1
    edges = np.sort(np.concatenate([offsets, np.array(cuts, np.int64)]))
    return pa.Array.from_buffers(pa.string(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)]), counts


def segments(lengths: np.ndarray) -> np.ndarray:
    """0 .. n-1 within each of consecutive runs of these lengths."""
    total = int(lengths.sum())
    starts = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(starts, lengths)


def column(name: str) -> Column:
    """A column whose name may hold dots or other signs."""
    return F.col("`" + name.replace("`", "``") + "`")


def held_apart(doc_id: str, modulus: int):
    """crc32 of doc_id written as text, modulo modulus; null doc_id gives null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(modulus)


def connected(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root): root is the smallest node that links lead to.  Only nodes with a link are returned.

    Alternates the large-star and small-star steps of Kiveris et al. (2014).
    Both steps are an aggregation (min of the neighbours, combined before the
    shuffle) and a join, so no neighbour list is ever held in one task, and
    links stay as many as they were at most.  Each round is written to the
    shared folder, which cuts the lineage.
    """
    spark = edges.sparkSession
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large, old = written(large, "cc"), now
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = written(small.distinct(), "cc")
        drop_written(large, old)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def trim() -> None:
    """Hand freed memory back to the system; Python workers wait for their next task with what they hold."""
    import contextlib
    import ctypes

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
