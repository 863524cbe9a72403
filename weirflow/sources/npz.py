"""NPZ files (zipped NumPy arrays) as tables, in and out, by a data source of Spark's Python API.

A row is one index of the first axis, which all arrays of a file share; an array of
rank 1, 2, 3 is a column of numbers, arrays, arrays of arrays.  NaN and NaT are NULL.
Files are planned as ranges of rows: a reader seeks in each stored member and reads
its own rows alone.  Deflated members cannot be entered in the middle: they are read
as a stream, in blocks, from their beginning, so their ranges are larger.

Paths are read by pyarrow.fs: those of mounted folders and of stores that it knows.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, LongType, StringType, StructField, StructType, TimestampNTZType

#: Bytes of a range's arrays; deflated files take DEFLATED times as many.
RANGE_BYTES = 64 << 20
DEFLATED = 8
#: Bytes of arrays that a reader hands on at once.
BATCH_BYTES = 4 << 20
#: Bytes of arrays of a written file, about.
FILE_BYTES = 128 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def matching(path: str) -> list[str]:
    """The files of a path: itself, those of a folder that end in .npz, or those that a pattern in its last part matches; sorted."""
    system, at = file_system(path)
    info = system.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    folder, pattern = (at, "*.npz") if info.type == pafs.FileType.Directory else posixpath.split(at)
    found = sorted(f.path for f in system.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if f.type == pafs.FileType.File and fnmatch.fnmatchcase(f.base_name, pattern))
    if not found:
        raise FileNotFoundError(f"nothing matches {path}")
    head = path[: len(path) - len(at)]
    return [head + f for f in found]


@dataclass(frozen=True)
class Member:
    """One array of a file: where its numbers begin, and whether they are stored as they are."""

    name: str
    shape: tuple[int, ...]
    dtype: str
    start: int
    stored: bool

    @property
    def row_bytes(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64)) * np.dtype(self.dtype).itemsize


def members(file, names: list[str] | None = None) -> list[Member]:
    """The arrays of an open file, from its directory and their headers alone."""
    found = []
    with zipfile.ZipFile(file) as z:
        for info in z.infolist():
            name = info.filename.removesuffix(".npy")
            if names is not None and name not in names:
                continue
            with z.open(info) as m:
                version = np.lib.format.read_magic(m)
                shape, fortran, dtype = np.lib.format.read_array_header_1_0(m) if version == (1, 0) else np.lib.format.read_array_header_2_0(m)
                header = m.tell()
            if not shape or fortran and len(shape) > 1 or dtype.hasobject:
                raise ValueError(f"{name}: only arrays in row order, of rank 1 and more, without objects")
            file.seek(info.header_offset + 26)
            skip = sum(struct.unpack("<HH", file.read(4)))
            found.append(Member(name, shape, dtype.str, info.header_offset + 30 + skip + header, info.compress_type == zipfile.ZIP_STORED))
    missing = set(names or ()) - {m.name for m in found}
    if missing:
        raise ValueError(f"no arrays {sorted(missing)} in the file")
    if len({m.shape[0] for m in found}) > 1:
        raise ValueError(f"arrays differ in length: {({m.name: m.shape[0] for m in found})}")
    return found


#: Spark's names ignore case: of two members that differ in case alone (Y_z, y_z) that of lower rank gets this ending.
SCALAR = "_scalar"


def column_names(own: list[Member]) -> list[str]:
    """The columns' names of members."""
    clash = {m.name for m in own if any(o.name != m.name and o.name.lower() == m.name.lower() and (len(o.shape), o.name) > (len(m.shape), m.name) for o in own)}
    return [m.name + SCALAR if m.name in clash else m.name for m in own]


def member_name(column: str, columns: list[str]) -> str:
    """The member's name of a column: without the ending, if another column is named so but for case."""
    plain = column.removesuffix(SCALAR)
    return plain if plain != column and any(c.lower() == plain.lower() for c in columns) else column


def spark_type(m: Member) -> DataType:
    dtype = np.dtype(m.dtype)
    kinds = {"b": BooleanType(), "i": LongType(), "u": LongType(), "f": FloatType() if dtype.itemsize <= 4 else DoubleType(), "M": TimestampNTZType(), "U": StringType()}
    if dtype.kind not in kinds:
        raise ValueError(f"{m.name}: arrays of {dtype} are not read")
    kind: DataType = kinds[dtype.kind]
    for _ in m.shape[1:]:
        kind = ArrayType(kind)
    return kind


def to_arrow(values: np.ndarray) -> pa.Array:
    """Rows of an array, NaN and NaT as null."""
    flat = np.ascontiguousarray(values).reshape(-1)
    if flat.dtype.kind == "M":
        flat = flat.astype("datetime64[us]")
        out = pa.array(flat, pa.timestamp("us"))
    elif flat.dtype.kind == "f":
        flat = flat.astype(np.float32 if flat.dtype.itemsize <= 4 else np.float64)
        out = pa.array(flat, mask=np.isnan(flat))
    elif flat.dtype.kind in "iu":
        out = pa.array(flat.astype(np.int64))
    else:
        out = pa.array(flat.tolist() if flat.dtype.kind == "U" else flat)
    for k in range(values.ndim - 1, 0, -1):
        n, size = int(np.prod(values.shape[:k], dtype=np.int64)), values.shape[k]
        out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int64) * size, pa.int32()), out)
    return out


@dataclass
class Range(InputPartition):
    path: str
    start: int
    stop: int


class NpzReader(DataSourceReader):
    def __init__(self, path: str, names: list[str] | None, range_bytes: int, place: bool):
        self.path, self.names, self.range_bytes, self.place = path, names, range_bytes, place

    def partitions(self) -> list[Range]:
        found = []
        for path in matching(self.path):
            system, at = file_system(path)
            with system.open_input_file(at) as f:
                own = members(f, self.names)
            rows = own[0].shape[0] if own else 0
            size = self.range_bytes * (1 if all(m.stored for m in own) else DEFLATED)
            step = max(size // max(sum(m.row_bytes for m in own), 1), 1)
            found += [Range(path, a, min(a + step, rows)) for a in range(0, rows, step)]
        return found or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start >= partition.stop:
            return
        system, at = file_system(partition.path)
        with system.open_input_file(at) as f:
            own = members(f, self.names)
            step = max(BATCH_BYTES // max(sum(m.row_bytes for m in own), 1), 1)
            streams = {}
            archive = None
            if not all(m.stored for m in own):
                archive = zipfile.ZipFile(f)
                for m in own:
                    if not m.stored:
                        streams[m.name] = s = archive.open(f"{m.name}.npy")
                        version = np.lib.format.read_magic(s)
                        (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(s)
                        left = partition.start * m.row_bytes
                        while left:
                            left -= len(s.read(min(left, 1 << 20)))
            for a in range(partition.start, partition.stop, step):
                n = min(step, partition.stop - a)
                columns = []
                for m in own:
                    if m.stored:
                        f.seek(m.start + a * m.row_bytes)
                        data = f.read(n * m.row_bytes)
                    else:
                        data = streams[m.name].read(n * m.row_bytes)
                    columns.append(to_arrow(np.frombuffer(data, m.dtype).reshape(n, *m.shape[1:])))
                names = column_names(own)
                if self.place:
                    columns += [pa.array([posixpath.basename(partition.path)] * n), pa.array(np.arange(a, a + n))]
                    names += ["npz_file", "npz_row"]
                yield pa.RecordBatch.from_arrays(columns, names)
            if archive is not None:
                archive.close()


def from_arrow(column: pa.Array, kind: DataType) -> np.ndarray:
    """A column as one array; null is NaN, NaT or false; arrays of a level must be of one length."""
    shape: list[int] = []
    while isinstance(kind, ArrayType):
        if column.null_count:
            raise ValueError("an array is missing: NPZ arrays have no gaps")
        sizes = np.diff(np.asarray(column.offsets))
        if len(sizes) and (sizes != sizes[0]).any():
            raise ValueError("arrays of a column differ in length")
        shape.append(int(sizes[0]) if len(sizes) else 0)
        column, kind = column.flatten(), kind.elementType
    if isinstance(kind, (FloatType, DoubleType)):
        flat = column.cast(pa.float32() if isinstance(kind, FloatType) else pa.float64()).to_numpy(zero_copy_only=False)
    elif isinstance(kind, BooleanType):
        flat = column.fill_null(False).to_numpy(zero_copy_only=False)
    elif isinstance(kind, TimestampNTZType):
        flat = column.cast(pa.timestamp("us")).to_numpy(zero_copy_only=False).astype("datetime64[ns]")
    elif isinstance(kind, StringType):
        flat = np.array(column.fill_null("").to_pylist(), dtype=np.str_)
    else:
        if column.null_count:
            raise ValueError("integers cannot be missing in NPZ")
        flat = column.cast(pa.int64()).to_numpy(zero_copy_only=False)
    rows = len(flat) // int(np.prod(shape, dtype=np.int64)) if shape and np.prod(shape) else len(flat) if not shape else 0
    return flat.reshape(rows, *shape)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class NpzWriter(DataSourceArrowWriter):
    """Each task writes files beside the place; the driver's commit moves them there and writes manifest.json."""

    def __init__(self, path: str, schema: StructType, compressed: bool, file_bytes: int, lineage: str, overwrite: bool):
        self.path, self.schema, self.compressed, self.file_bytes, self.lineage, self.overwrite = path, schema, compressed, file_bytes, lineage, overwrite
        self.beside = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, at = file_system(self.path)
        system.create_dir(f"{at}/{self.beside}")
        held: list[pa.RecordBatch] = []
        size, files = 0, []

        def flush() -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            name = f"part-{task.partitionId():05d}-{len(files):03d}-{task.taskAttemptId()}.npz"
            with system.open_output_stream(f"{at}/{self.beside}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if self.compressed else zipfile.ZIP_STORED, allowZip64=True) as z:
                for field in self.schema.fields:
                    column = table.column(field.name).combine_chunks()
                    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
                    with z.open(f"{member_name(field.name, self.schema.names)}.npy", "w", force_zip64=True) as member:
                        np.lib.format.write_array(member, np.ascontiguousarray(from_arrow(column, field.dataType)), allow_pickle=False)
            files.append((name, table.num_rows))
            held.clear()

        for batch in iterator:
            at_once = max(batch.num_rows * self.file_bytes // max(batch.nbytes, 1), 1)
            for k in range(0, batch.num_rows, at_once):
                held.append(batch.slice(k, at_once))
                size += held[-1].nbytes
                if size >= self.file_bytes:
                    flush()
                    size = 0
        if held:
            flush()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = file_system(self.path)
        system.create_dir(at)
        if self.overwrite:
            for f in system.get_file_info(pafs.FileSelector(at)):
                if f.type == pafs.FileType.File and (f.base_name.endswith(".npz") or f.base_name == "manifest.json"):
                    system.delete_file(f.path)
        files = sorted(f for m in messages if m is not None for f in m.files)
        for name, _ in files:
            system.move(f"{at}/{self.beside}/{name}", f"{at}/{name}")
        if system.get_file_info(f"{at}/{self.beside}").type == pafs.FileType.Directory:
            system.delete_dir(f"{at}/{self.beside}")
        about = {**json.loads(self.lineage), "n_samples": sum(n for _, n in files), "files": [{"name": name, "rows": n} for name, n in files]}
        with system.open_output_stream(f"{at}/manifest.json") as out:
            out.write(json.dumps(about, indent=2).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, at = file_system(self.path)
        if system.get_file_info(f"{at}/{self.beside}").type == pafs.FileType.Directory:
            system.delete_dir(f"{at}/{self.beside}")


class NpzSource(DataSource):
    """Format npz.  Options: path; columns (names, by commas); range_bytes; place (true adds npz_file and npz_row); compressed, file_bytes and lineage (JSON) to write."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def _names(self) -> list[str] | None:
        names = self.options.get("columns")
        return names.split(",") if names else None

    def _place(self) -> bool:
        return self.options.get("place", "false").lower() == "true"

    def schema(self) -> StructType:
        system, at = file_system(matching(self.options["path"])[0])
        with system.open_input_file(at) as f:
            own = members(f, self._names())
        fields = [StructField(name, spark_type(m)) for name, m in zip(column_names(own), own, strict=True)]
        return StructType(fields + ([StructField("npz_file", StringType()), StructField("npz_row", LongType())] if self._place() else []))

    def reader(self, schema: StructType) -> NpzReader:
        return NpzReader(self.options["path"], self._names(), int(self.options.get("range_bytes", RANGE_BYTES)), self._place())

    def writer(self, schema: StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options["path"], schema, self.options.get("compressed", "false").lower() == "true", int(self.options.get("file_bytes", FILE_BYTES)), self.options.get("lineage", "{}"), overwrite)


def read(spark: SparkSession, path: str, columns: list[str] | None = None, place: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The files' arrays as columns; with place also the file and the index of each row."""
    spark.dataSource.register(NpzSource)
    reader = spark.read.format("npz").option("place", str(place).lower()).option("range_bytes", range_bytes)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load(path)


def write(df: DataFrame, path: str, compressed: bool = False, lineage: dict | None = None, file_bytes: int = FILE_BYTES) -> None:
    """df as NPZ files in a folder, with manifest.json beside them; what stood there goes when the new files are whole."""
    df.sparkSession.dataSource.register(NpzSource)
    df.write.format("npz").mode("overwrite").option("compressed", str(compressed).lower()).option("file_bytes", file_bytes).option("lineage", json.dumps(lineage or {})).save(path)
