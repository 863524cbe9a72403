"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority over the hashes of a text's word
shingles.  Two fingerprints within ``radius`` bits share a value within
``radius / 2`` bits of both, so every distinct fingerprint emits all values of
that ball, fingerprints meet on equal values, and those that met are verified.
All members of one ball of half the radius are within the radius of each other,
so links to the neighbour in sorted order carry every connection of a meeting
and no pairs are expanded.

Defined results: null text counts as empty; a text without words has
fingerprint zero, linked like any other; equal rows are copies and share a
group; a null doc_id takes part in linking and is named a component only when
no other id is there.  Further columns are ignored.  An empty table gives an
empty result.  A long text's shingles are hashed in blocks of ``BLOCK`` and their
bits counted, so a worker holds its words (some ten times the text) alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import chunks, column, connected, small_batches, written

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Shingles that are hashed at once.
BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, a bit set where over half of the shingle hashes have it.

    bytes.lower() folds A-Z alone and bytes.split() cuts at 0x20 and 0x09-0x0D alone.
    """
    words = text.lower().split()
    if not words:
        return 0
    parts = iter([b" ".join(words)]) if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    total, counts = 0, np.zeros(64, np.int64)
    while len(hashes := np.fromiter(map(xxhash.xxh64_intdigest, islice(parts, BLOCK), repeat(seed)), np.uint64)):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64) if len(hashes) > 255 else np.add.reduce(bits, axis=0, dtype=np.uint8)
        total += len(hashes)
        if len(hashes) < BLOCK:
            break
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, row: Column | None = None) -> DataFrame:
    """(doc_id, fp), and row (a long of the caller's) where one is given: fp is the fingerprint as a signed long."""
    more = [] if row is None else [row.alias("row")]
    names = ["doc_id", "fp", *(["row"] if more else [])]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            texts = batch.column(1).fill_null(b"").to_pylist()
            fps = np.fromiter((fingerprint(t, shingle, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names)

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), *more).mapInArrow(each, ", ".join(f"{n} long" for n in names))


def ball(radius: int) -> list[int]:
    """All 64-bit masks of at most radius bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of distinct fingerprints within radius bits, enough of them to join all that any such pair joins.

    An odd radius takes a ball of half the radius, rounded up; the pairs that
    meet there beyond the radius are then not sure to be joined by neighbours in
    order, so odd radii are refused.
    """
    if radius < 0 or radius % 2:
        raise ValueError("radius must be even: balls of half the radius meet in the middle")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(radius // 2)])
    met = fps.select("fp").distinct().select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    near = met.select("fp", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")).alias("before"))
    return (
        near.where(F.col("before").isNotNull() & (F.bit_count(F.col("fp").bitwiseXOR(F.col("before"))) <= radius))
        .select(F.col("before").alias("a"), F.col("fp").alias("b"))
        .distinct()
    )


def _rooted(own: DataFrame, radius: int) -> DataFrame:
    """(fp, first_id, root): each distinct fingerprint of own, the least doc_id that has it and its group's root."""
    firsts = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected(links(own, radius)).toDF("fp", "root")
    return written(firsts.join(roots, "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "simhash")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint hex, component_id) for each row of docs."""
    own = written(fingerprints(docs, shingle, seed), "simhash")
    named = _rooted(own, radius)
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    names = named.join(least, "root").select("fp", "component_id")
    return own.join(names, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs without all but one document of each group: that with the smallest doc_id stays.

    Groups are told apart by their root, not by an id: each keeps one row, also
    where it has no doc_id at all or shares one with another group.  Of several
    rows of this doc_id in the group the one of least content hash stays, and
    one of rows that are equal.
    """
    # The hash skips nulls, so where they are goes in too: equal keys are equal rows, and so of one group.
    content = F.xxhash64(*map(column, docs.columns), *(column(c).isNull() for c in docs.columns))
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    own = written(fingerprints(docs, shingle, seed, content), "simhash")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    least = own.join(_rooted(own, radius).select("fp", "root"), "fp").groupBy("root").agg(F.min_by(F.struct(number.alias("number"), "row"), order).alias("first"))
    keys = least.select("first.number", F.col("first.row").alias("content"))
    rows = docs.select(number.alias("number"), content.alias("content"), F.struct(*map(column, docs.columns)).alias("row"))
    alone = rows.join(keys, ["number", "content"], "left_semi").groupBy("number", "content").agg(F.first("row").alias("row"))
    return alone.select("row.*")
