"""Packing along a space-filling curve.

A document's words are hashed to a sparse vector of counts, which a fixed
random projection takes to a few dimensions.  The direction there is a point
of a grid, its place on the Hilbert curve (Skilling, 2004) the sort key.
Documents lie along the curve in one sequence of ids that is cut every
``length`` ids, so neighbours share sequences and only the last one has
padding.

Defined results: null and empty texts have the end id alone (no direction,
so the grid's middle); copies are neighbours; a null doc_id and repeated rows
are documents like any other; further columns are left out; an empty table gives
an empty result.  A long text's vector is the sum over pieces that end before
white space, so a worker never holds a multiple of it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import chunks, long_pieces, shared_path, small_batches, text_bytes
from weirflow.llm.tokens import bases, crcs, list_parts, lists_of, parts_for, write_tokens

LENGTH = 2048
END = 1
DIMS = 4
BITS = 15
BUCKETS = 1 << 12
#: Documents whose keys set the borders of the range parts: so many for each part, and so many at least.  They come to
#: the driver (24 bytes each, 300 MB for the parts of 100 TB), balance the parts and change no result's order.
BORDERS_PER_PART, BORDER_ROWS = 8, 50_000
#: Text bytes whose words are hashed at once.
VECTOR_BYTES = 1 << 20


_IS_SPACE = np.array([c in b" \t\n\r\x0b\x0c" for c in range(256)])
_BYTE_VALUES = np.random.default_rng(9).integers(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, at least size of them; the last tables are kept."""
    n = 1 << max(size - 1, 1).bit_length()
    if n not in _TABLES:
        _TABLES.clear()
        _TABLES[n] = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(b))])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    return _TABLES[n]


def projection(buckets: int = BUCKETS, dims: int = DIMS, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((buckets, dims)).astype(np.float32)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows, dims), dims * bits < 64."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _sums(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """The sum of the projections of each text's words."""
    data, offsets = text_bytes(texts)
    sums = np.zeros((len(texts), table.shape[1]), np.float32)
    wordy = ~_IS_SPACE[data]
    edge = np.diff(np.concatenate([[False], wordy, [False]]).astype(np.int8))
    edge_at = offsets[1:-1]  # a word ends with its text
    edge_at = edge_at[(edge_at > 0) & (edge_at < len(data))]
    joined = edge_at[wordy[edge_at - 1] & wordy[edge_at]] if len(data) else edge_at
    starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), joined]))
    ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), joined]))
    if len(starts):
        powers, inverses = _power_tables(len(data))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[data] * powers[: len(data)])])
        hashed = (prefix[ends] - prefix[starts]) * inverses[starts] * np.uint64(0xBF58476D1CE4E5B9)
        rows = table[(hashed >> np.uint64(40)).astype(np.int64) % len(table)]
        row = np.searchsorted(offsets, starts, side="right") - 1
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        sums[row[first]] = np.add.reduceat(rows, first, axis=0)
    return sums


def curve_keys(texts: pa.Array, table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert key of each text: its vector counts the buckets that its words (ASCII white space apart) hash to."""
    pieces, counts = long_pieces(texts, VECTOR_BYTES)
    if counts is None:
        sums = _sums(texts, table)
    else:
        each = np.concatenate([_sums(b.column(0), table) for b in chunks([pa.RecordBatch.from_arrays([pieces], ["text"])], 0, VECTOR_BYTES)])
        sums = np.add.reduceat(each, np.cumsum(counts) - counts, axis=0)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = np.where(norm > 0, sums / np.maximum(norm, 1e-12), 0.0)
    return hilbert(np.clip(((unit + 1) / 2 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1), bits)


def along_curve(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, tie, text) with key, in parts ranges of (key, tie), each sorted."""

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = projection()
        for batch in chunks(batches, 2):
            yield pa.RecordBatch.from_arrays([pa.array(curve_keys(batch.column(2), table)), batch.column(1), pc.binary_length(batch.column(2)).cast(pa.int64())], ["key", "tie", "size"])

    rows, wanted = docs.count(), max(BORDER_ROWS, BORDERS_PER_PART * parts)
    drawn = docs if rows <= wanted else docs.where(F.pmod(F.xxhash64("doc_id", "tie", F.lit(3)), F.lit(1 << 40)) < int((1 << 40) * (wanted / rows)))
    found = drawn.mapInArrow(keys, "key long, tie long, size long").toArrow()
    key, tie, size = (np.asarray(found.column(c)) for c in ("key", "tie", "size"))
    order = np.lexsort((tie, key))
    upto = np.cumsum(1 + size[order])
    at = order[np.searchsorted(upto, upto[-1] * np.arange(1, parts) / parts)] if len(order) else order
    borders = list(zip(key[at].tolist(), tie[at].tolist(), strict=True))

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = projection()
        for batch in chunks(batches, 2):
            key = curve_keys(batch.column(2), table)
            part = [bisect_right(borders, at) for at in zip(key.tolist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key), pa.array(part, pa.int32())], ["doc_id", "tie", "text", "key", "part"])

    return docs.mapInArrow(dealt, "doc_id long, tie long, text string, key long, part int").repartitionById(parts, "part").sortWithinPartitions("key", "tie")


def packed(docs: DataFrame, length: int = LENGTH, end_id: int = END, tokenizer: str | None = None, path: str | None = None, digest: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and the piece's ids (with digest their crc32).

    The token table along the curve stays at path, ORC as in tokens.py; pieces are cut as it is read back.
    """
    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    table = write_tokens(along_curve(own, parts_for(own)), path or shared_path(docs.sparkSession, "packing"), end_id, tokenizer)
    sent = docs.sparkSession.sparkContext.broadcast(bases(table))
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    last = ("ids_crc32", "long") if digest else ("ids", "array<int>")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = sent.value
        for batch in batches:
            ids, offsets = list_parts(batch.column(3))
            n = np.diff(offsets)
            at = np.asarray(batch.column(2)) + np.array([base[p] for p in batch.column(1).to_pylist()], np.int64)
            pieces = (at + n - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = at[row] // length + nth
            begin = np.maximum(at[row], sequence * length)
            size = np.minimum(at[row] + n[row], (sequence + 1) * length) - begin
            ends = np.cumsum(size)
            content = pa.array(crcs(ids, ends - size, ends), pa.int64()) if digest else lists_of(ids, size)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), *map(pa.array, (begin - at[row], size, n[row], sequence, begin - sequence * length)), content], [*names, last[0]])

    return table.select("doc_id", "part", "local", "ids").mapInArrow(cut, ", ".join([*(f"{x} long" for x in names), " ".join(last)]))
