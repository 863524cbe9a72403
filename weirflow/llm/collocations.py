"""Phrase collocations: frequent n-grams of a corpus and how much their parts belong together.

Frequent words get numbers; pieces of text are broken at all other words; n-grams of
numbers are packed in fixed-width binary keys, which are sorted by radix and counted
as runs, first in each block, then in ranges of all keys.  Ranges are of a
scramble of the key, so common first words do not crowd one of them.  Phrases
of three words are counted only where both pairs in them are frequent: no other can be.

A phrase is a candidate where it occurs ``least`` times or more within pieces.  Its
score is 1,000,000 a*a / (l*r), floored, for the cut into a first part (l times) and a
rest (r times) that gives least, the first of equal ones.  A candidate goes where a
longer candidate that holds its words one after the other occurs at least half as often.

Defined results: null text counts as empty and gives nothing; null lang is ``und``
(with the texts whose lang says so); an empty lang is one like others; repeated rows
count each; equal scores are ordered by a, then by the phrase's UTF-8 bytes; further
columns are ignored; an empty table gives an empty result.  A long text is split
in pieces of 4 MB; a worker holds 4 bytes for each word of a block, the block of a
text beyond 16 MB is that text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.blocks import BLOCK_BYTES, LAST, Numbers, meeting, met, numbers, pieces, split_at_spaces, with_ids
from weirflow.llm.common import drop_written, small_batches, written

LEAST = 10
TOP = 2000
#: Bits of a word's number in a key; two longs hold three of them.
BITS = 42
_LOW = (1 << 21) - 1
#: Words of a block that are made n-grams of at once: their ranks fit in 21 bits.
STRETCH = 1 << 20
#: n-grams for a range of keys, about.
RANGE_ROWS = 2_000_000
# A-Z fold, the tab is a space, these characters end a piece.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if chr(c) in ".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def _coded(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, lang, words, counts, codes): a block's words of one language; -1 among the codes (int32) ends a piece."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Numbers, list[np.ndarray]]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, (known, streams) in held.items():
                stream = np.concatenate(streams)
                words = list(known.known)
                counts = np.bincount(stream[stream >= 0], minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([stream.astype("<i4").tobytes()])], ["lang", "words", "counts", "codes"])
            held.clear()

        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch.filter(pa.compute.equal(langs.indices, k))
                for data, offsets, _, last in pieces(own, 1):
                    size += len(data)
                    known, streams = held.setdefault(lang, (Numbers(), []))
                    streams.append(_stream(data, offsets, last, known))
                    if size >= block_bytes and last[-1]:
                        yield from flush()
                        size = 0
        yield from flush()

    rows = small_batches(docs).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("length(text) > 0")
    return written(rows.mapInArrow(each, "lang string, words array<string>, counts array<long>, codes binary").withColumn("block", F.monotonically_increasing_id()), "words")


def _stream(data: np.ndarray, offsets: np.ndarray, last: np.ndarray, known: Numbers) -> np.ndarray:
    """The texts' words as numbers, -1 where a piece or a text ends."""
    data = np.frombuffer(data.tobytes().translate(_FOLD), np.uint8)
    marks = np.flatnonzero(data == 10)
    apart = np.insert(data, np.concatenate([marks, marks + 1]), np.uint8(32))
    values, edges = split_at_spaces(apart, offsets + np.searchsorted(marks, offsets, side="left") * 2)
    coded = values.dictionary_encode()
    strings = coded.dictionary.to_pylist()
    table = np.fromiter((-2 if w == "" else -1 if w == "\n" else known.known.setdefault(w, len(known.known)) for w in strings), np.int64, len(strings))
    codes = np.insert(table[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64), edges[1:][last], -1)
    return codes[codes != -2].astype(np.int32)


def radix_order(digits: list[np.ndarray]) -> np.ndarray:
    """The stable order of keys that are given by arrays of unsigned 64-bit parts, the lowest first: 16 bits at a time, from the lowest."""
    order = np.arange(len(digits[0]))
    for part in digits:
        top = int(part.max()) if len(part) else 0
        for shift in range(0, top.bit_length(), 16):
            digit = (part >> np.uint64(shift)).astype(np.uint16)
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def _runs(*sorted_parts: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    n = len(sorted_parts[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for p in sorted_parts:
        new[1:] |= p[1:] != p[:-1]
    return np.flatnonzero(new)


def _packed(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three numbers under 2**42 as two longs, in the same order."""
    return first << 21 | second >> 21, (second & _LOW) << BITS | third


def unpacked(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return hi >> 21, (hi & _LOW) << 21 | lo >> BITS, lo & ((1 << BITS) - 1)


def _scramble(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """32 bits that differ widely for near keys."""
    h = hi.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ lo.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h >> np.uint64(32)


def _counted(ids: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hi, lo, times) of the n-grams of a stream of numbers (0: a break), sorted and counted by stretches.

    Without pairs those of two numbers; else of three numbers whose pairs are among these keys (sorted).
    """
    width = 2 if pairs is None else 3
    for at in range(0, max(len(ids) - width + 1, 0), STRETCH):
        own = ids[at : at + STRETCH + width - 1]
        distinct = np.unique(own)
        ranks = np.searchsorted(distinct, own).astype(np.uint64)
        if distinct[0]:
            ranks += np.uint64(1)
            distinct = np.concatenate([[0], distinct])
        two = ranks[:-1] << np.uint64(21) | ranks[1:]
        fits = (ranks[:-1] > 0) & (ranks[1:] > 0)
        if pairs is None:
            keys = two[fits]
            keys = keys[radix_order([keys])]
            starts = _runs(keys)
            first, second, third = distinct[(keys[starts] >> np.uint64(21)).astype(np.int64)], distinct[(keys[starts] & np.uint64(_LOW)).astype(np.int64)], np.zeros(len(starts), np.int64)
        else:
            a, b, _ = unpacked(*pairs)
            x, y = np.searchsorted(distinct, a), np.searchsorted(distinct, b)
            there = (x < len(distinct)) & (y < len(distinct))
            there[there] &= (distinct[x[there]] == a[there]) & (distinct[y[there]] == b[there])
            common = np.sort(x[there].astype(np.uint64) << np.uint64(21) | y[there].astype(np.uint64))
            place = np.minimum(np.searchsorted(common, two), max(len(common) - 1, 0))
            fits &= (common[place] == two) if len(common) else False
            at_both = np.flatnonzero(fits[:-1] & fits[1:])
            keys = two[at_both] << np.uint64(21) | ranks[at_both + 2]
            keys = keys[radix_order([keys])]
            starts = _runs(keys)
            first, second, third = (distinct[(keys[starts] >> np.uint64(s) & np.uint64(_LOW)).astype(np.int64)] for s in (42, 21, 0))
        yield *_packed(first, second, third), np.diff(np.append(starts, len(keys)))


_KEYS = "hi long, lo long, times long, block long, part int"


def _ngrams(coded: DataFrame, entries: DataFrame, pairs: DataFrame | None, ranges: int) -> DataFrame:
    """(hi, lo, times, block, part): a block's counted n-grams, and the range of each."""
    triples = pairs is not None

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts, rows in met(batches):  # a block has one row of codes
            local, value = numbers(parts.get(0), 2), numbers(parts.get(0), 3)
            two = None
            if triples:
                two = numbers(parts.get(1), 2), numbers(parts.get(1), 3)
                if not len(two[0]):
                    continue
            for codes in rows.column(5).to_pylist():
                codes = np.frombuffer(codes, "<i4")
                ids = np.zeros(max(int(codes.max(initial=-1)) + 2, 2), np.int64)
                ids[local + 1] = value  # the break's -1 is at 0
                for hi, lo, times in _counted(ids[codes + 1], two):
                    part = (_scramble(hi, lo) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
                    for k in range(0, len(hi), 1 << 16):
                        s = slice(k, k + (1 << 16))
                        yield pa.RecordBatch.from_arrays([pa.array(hi[s]), pa.array(lo[s]), pa.array(times[s]), pa.array(np.full(len(hi[s]), block)), pa.array(part[s])], ["hi", "lo", "times", "block", "part"])

    parts = [coded.select("block", F.lit(LAST).alias("kind"), "codes"), entries.select("block", F.lit(0).alias("kind"), F.col("local").alias("a"), F.col("id").alias("b"))]
    if pairs is not None:
        parts.append(pairs.select("block", F.lit(1).alias("kind"), F.col("hi").alias("a"), F.col("lo").alias("b")))
    return meeting(*parts).mapInArrow(each, _KEYS)


def _frequent(grams: DataFrame, ranges: int, least: int) -> DataFrame:
    """(hi, lo, block, a, first): the rows of n-grams with a >= least, of which one is the first of its key."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), schema=schema)
        hi, lo, times, block = (np.asarray(table.column(k).to_numpy()) for k in range(4))
        del table
        order = radix_order([lo.astype(np.uint64), hi.astype(np.uint64)])
        hi, lo, times, block = hi[order], lo[order], times[order], block[order]
        starts = _runs(hi, lo)
        totals = np.add.reduceat(times, starts) if len(starts) else np.zeros(0, np.int64)
        each_total = np.repeat(totals, np.diff(np.append(starts, len(hi))))
        first = np.zeros(len(hi), bool)
        first[starts] = True
        keep = np.flatnonzero(each_total >= least)
        for k in range(0, len(keep), 1 << 16):
            s = keep[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (hi, lo, block, each_total, first)], ["hi", "lo", "block", "a", "first"])

    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("times", pa.int64()), ("block", pa.int64())])
    dealt = grams.repartitionById(ranges, F.col("part")).select("hi", "lo", "times", "block")
    return written(dealt.mapInArrow(each, "hi long, lo long, block long, a long, first boolean"), "grams")


def _candidates(rows: DataFrame) -> DataFrame:
    """(i1, i2, i3, a) of each key."""
    hi, lo = F.col("hi"), F.col("lo")
    second = F.shiftleft(hi.bitwiseAND(F.lit(_LOW)), 21).bitwiseOR(F.shiftright(lo, BITS))
    return rows.where("first").select(F.shiftright(hi, 21).alias("i1"), second.alias("i2"), lo.bitwiseAND(F.lit((1 << BITS) - 1)).alias("i3"), "a")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, block_bytes: int = BLOCK_BYTES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first ``top`` phrases of two or three words of docs (lang, text)."""
    spark = docs.sparkSession
    coded = _coded(docs, block_bytes)
    totals = written(coded.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_rows))

    both = coded.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
    known = with_ids(both.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least), "frequent")
    own = coded.select("block", "lang", F.posexplode("words").alias("local", "word"))
    entries = written(own.join(known.select("lang", "word", "id"), ["lang", "word"]).select("block", "local", "id"), "entries")

    two = _frequent(_ngrams(coded, entries, None, ranges), ranges, least)
    three = _frequent(_ngrams(coded, entries, two, ranges), ranges, least)
    drop_written(entries, coded)
    return _ranked(written(_candidates(two), "pairs"), written(_candidates(three), "triples"), known, totals, top)


def _score(a, part, rest):
    """floor(1000000 a*a / (l*r)); the products are exact decimals, up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    over = (wide(a) * wide(a)).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", over, wide(part) * wide(rest))


def _ranked(two: DataFrame, three: DataFrame, known: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    word = lambda k: known.select(F.col("id").alias(f"i{k}"), F.col("word").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else []))
    pair = lambda x, y, name: two.select(F.col("i1").alias(x), F.col("i2").alias(y), F.col("a").alias(name))
    cuts = three.join(pair("i1", "i2", "f12"), ["i1", "i2"]).join(pair("i2", "i3", "f23"), ["i2", "i3"])
    longer = three.select(F.explode(F.array(F.struct("i1", "i2"), F.struct(F.col("i2").alias("i1"), F.col("i3").alias("i2")))).alias("p"), "a").groupBy("p.i1", "p.i2").agg(F.max("a").alias("most"))
    left = two.join(longer, ["i1", "i2"], "left").where("most IS NULL OR 100 * most < 50 * a")

    pairs = left.join(word(1), "i1").join(word(2), "i2").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score(F.col("a"), F.col("f1"), F.col("f2")).alias("score"))
    triples = cuts.join(word(1), "i1").join(word(2), "i2").join(word(3), "i3")
    first, second = _score(F.col("a"), F.col("f1"), F.col("f23")), _score(F.col("a"), F.col("f12"), F.col("f3"))
    best = F.when(first <= second, F.struct(F.col("f1").alias("l"), F.col("f23").alias("r"), first.alias("score"))).otherwise(F.struct(F.col("f12").alias("l"), F.col("f3").alias("r"), second.alias("score")))
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")

    # A language's phrases are ranked in 64 lots first: the last task gets 64 * top rows of it at most.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    lots = pairs.unionByName(triples).withColumn("lot", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    lots = lots.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lot").orderBy(*order))).where(F.col("rank") <= top)
    ranked = lots.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
