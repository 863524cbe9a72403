"""Texts coded against small dictionaries, and the exchange that gives these dictionaries corpus-wide values.

A block is some megabytes of text that one task reads: its distinct strings, and
for each text the numbers that these have in the block.  Only a block's distinct
strings are shuffled, to meet what is known of them in the whole corpus; the answers
then meet the block's numbers again, block by block.  So no dictionary of the corpus
is held by the driver or by a task, and what is shuffled are flat rows, one for
each block and distinct string.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import chunks, long_pieces, text_bytes, written

#: UTF-8 bytes of text of a block; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: UTF-8 bytes of text whose strings are numbered at once.
PIECE_BYTES = 4 << 20


class Numbers:
    """Numbers from 0 for distinct strings, in the order in which they come."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, values: pa.Array) -> np.ndarray:
        coded = pc.dictionary_encode(values)
        known = self.known
        own = np.fromiter((known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        return own[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64)


def split_at_spaces(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(strings between single spaces, empty ones too; edges of each text's strings)."""
    texts = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    lists = pc.split_pattern(texts, " ")
    return lists.values, np.asarray(lists.offsets).astype(np.int64)


def pieces(batch: pa.RecordBatch, column: int, most: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, rows, whether a row ends here): the batch's texts, long ones cut before white space; all but the last row end."""
    texts, counts = long_pieces(batch.column(column), most)
    row = np.arange(batch.num_rows) if counts is None else np.repeat(np.arange(batch.num_rows), counts)
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    at = 0
    for part in chunks([pa.RecordBatch.from_arrays([texts], ["text"])], 0, most):
        data, offsets = text_bytes(part.column(0))
        own = slice(at, at + part.num_rows)
        at += part.num_rows
        ends = last[own].copy()
        ends[-1] = True  # pieces of one row side by side are one piece
        yield data, np.concatenate([offsets[:1], offsets[1:][ends]]), row[own][ends], last[own][ends]


def with_ids(table: DataFrame, tag: str, name: str = "id") -> DataFrame:
    """table written, with ids 1, 2, ... in the order of its files.  The counts of its parts alone are ordered in one task."""
    own = written(table.withColumn("_mono", F.monotonically_increasing_id()), tag)
    part, place = F.shiftright("_mono", 33), F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    parts = own.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    found = own.withColumn("_part", part).join(before, "_part").withColumn(name, F.col("_before") + place + 1).drop("_mono", "_part", "_before")
    found._written = own._written
    return found


#: Columns of rows that meet by block: kind orders a block's rows, those of kind LAST come after the others.
MEETING = "block long, kind int, a long, b long, s string, codes binary, row long, doc_id long, v array<long>"
LAST = 9


def meeting(*tables: DataFrame) -> DataFrame:
    """The tables' rows with the columns of MEETING, missing ones null, side by side by block, those of kind LAST at the end."""
    names = [c.split() for c in MEETING.split(", ")]
    rows = None
    for t in tables:
        own = t.select(*(F.col(n).cast(k).alias(n) if n in t.columns else F.lit(None).cast(k).alias(n) for n, k in names))
        rows = own if rows is None else rows.unionAll(own)
    return rows.repartition("block").sortWithinPartitions("block", "kind", "row")


def met(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[pa.RecordBatch]] | None, pa.RecordBatch]]:
    """(block, its rows by kind, a batch of its rows of kind LAST) of what meeting() has brought together.

    The rows by kind come with a block's first batch alone, for the caller to take over; then None.
    """
    held: dict[int, list[pa.RecordBatch]] = {}
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        block, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
            if block[a] != now:
                now, held, given = block[a], {}, False
            part = batch.slice(a, b - a)
            if kind[a] != LAST:
                held.setdefault(int(kind[a]), []).append(part)
                continue
            handed, held = (None if given else held), {}
            given = True
            yield int(now), handed, part


def numbers(parts: list[pa.RecordBatch] | None, column: int) -> np.ndarray:
    """A long column of meeting rows as an array."""
    return np.concatenate([np.zeros(0, np.int64), *(p.column(column).to_numpy().astype(np.int64) for p in parts or ())])
