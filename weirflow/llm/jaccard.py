"""Groups of documents whose sets of word n-grams are alike, by prefix filters under several token orders.

Two sets of Jaccard similarity t or more share a token among the first
n - ceil(t n) + 1 tokens of each, whatever the order of all tokens is.  Three orders
serve: by the token's hash; by how many of the sets hold it, rare first, ties by the
hash; the same with ties by another hash.  The first needs no counts, so it is
taken for all sets, with a tenth of n tokens more: a set goes on only if others have
a tenth or more (of the least size that may be alike) of these too.
Only for these are tokens counted.  Under the second order sets meet on equal
tokens; pairs that share no token under the third and first go before any two
sets are compared.

Equal sets are one class.  Where many classes meet on one token, no pairs are made
of them at first: each is compared with two of them, and what is linked becomes one
group.  Pairs are made only of classes of different groups that met; so no link
between groups is lost, and crowds of near copies cost a few comparisons each.

Tokens are 63-bit hashes of the n-grams (classes 128-bit hashes of the sets).  Defined
results: fewer words than n are one token, the whole sequence; null texts and
those without words have no tokens and are linked with nothing, each its own
component; a null doc_id takes part in linking, and is named a component where no
other is there; repeated rows and ties are equal sets; further columns are ignored;
an empty table gives an empty result.  Of a long text a worker holds 8 bytes for
each word and some 40 for each n-gram; its tokens are one row's array.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm.blocks import pieces, split_at_spaces, with_ids
from weirflow.llm.common import connected, drop_written, small_batches, written

SHINGLE = 5
#: Two documents link from this many hundredths of their union on.
PERCENT = 80
# A-Z fold, ASCII white space separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scrambled unsigned 64-bit numbers."""
    x = x ^ np.uint64(_MIX[seed % 8])
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _factors(n: int) -> list[np.uint64]:
    return [np.uint64((_MIX[k % 8] * (2 * k + 1) | 1) & (2**64 - 1)) for k in range(n)]


def _tokens(words: np.ndarray, edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct tokens of each text, sorted; how many) from the hashes of all words and the texts' edges."""
    lengths = np.diff(edges)
    row, factors = np.repeat(np.arange(len(lengths)), lengths), _factors(size)
    n = len(words) - size + 1
    found, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        sums = words[:n] * factors[0]
        for k in range(1, size):
            sums += words[k : k + n] * factors[k]
        own = np.flatnonzero(row[:n] == row[size - 1 :])
        found, owner = sums[own], row[own]
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    if len(short):
        sums = [np.uint64(sum(int(w) * int(f) for w, f in zip(words[edges[r] : edges[r + 1]], factors, strict=False)) + int(lengths[r]) & (2**64 - 1)) for r in short]
        found, owner = np.concatenate([found, np.array(sums, np.uint64)]), np.concatenate([owner, short])
    found = mixed(found) >> np.uint64(1)
    order = np.argsort(found)
    few = len(lengths) <= 1 << 16  # then the stable order of owners is a radix sort
    order = order[np.argsort(owner[order].astype(np.uint16) if few else owner[order], kind="stable")]
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.bincount(owner[new], minlength=len(lengths))


def token_sets(batch: pa.RecordBatch, column: int, size: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, tokens of each, how many) of the batch's texts, in order."""
    carried = np.zeros(0, np.uint64)
    for data, offsets, row, last in pieces(batch, column):
        values, edges = split_at_spaces(np.frombuffer(data.tobytes().translate(_FOLD), np.uint8), offsets)
        coded = values.dictionary_encode()
        strings = coded.dictionary.cast(pa.binary()).to_pylist()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, strings), np.uint64, len(strings))
        full = np.fromiter(map(len, strings), np.int64, len(strings)) > 0
        codes = np.asarray(coded.indices) if len(coded) else np.zeros(0, np.int64)
        there = full[codes]
        edges = np.concatenate([[0], np.cumsum(there)])[edges]
        words = hashes[codes[there]]
        if len(carried):
            words, edges = np.concatenate([carried, words]), np.concatenate([[0], edges[1:] + len(carried)])
            carried = carried[:0]
        if not last[-1]:
            carried, words = words[edges[-2] :], words[: edges[-2]]
            edges, row = edges[:-1], row[:-1]
        if len(row):
            yield row, *_tokens(words, edges, size)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of consecutive runs, as signed longs."""
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    ends = np.cumsum(counts)
    return (before[ends] - before[ends - counts]).view(np.int64)


def _prefix(n, percent: int, shared=1):
    """Of how many first tokens of a set of n another one must share so many to be alike."""
    return np.minimum(n - (n * percent + 99) // 100 + shared, n)


def _shared(n):
    """How many of its first tokens by hash a set must share: a tenth of its size, so that a common passage alone does not do."""
    return (n + 9) // 10


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(flat.astype(np.int64)))


def _within(counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _sets(docs: DataFrame, size: int, percent: int, whole: bool) -> DataFrame:
    """(number, key, n, f1, f2, tokens) of rows (number, key, text): the first tokens by hash alone, or the whole set."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, flat, counts in token_sets(batch, 2, size):
                prints = [_sums(mixed(flat, seed), counts) for seed in (3, 5)]
                if not whole:
                    keep = _prefix(counts, percent, _shared(counts))
                    flat, given = flat[_within(counts) < np.repeat(keep, counts)], keep
                else:
                    given = counts
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(counts.astype(np.int64)), *map(pa.array, prints), _lists(flat, given)], ["number", "key", "n", "f1", "f2", "tokens"])

    return small_batches(docs).select("number", "key", "text").mapInArrow(each, "number long, key long, n long, f1 long, f2 long, tokens array<long>")


def _prefixes(held: DataFrame, percent: int) -> DataFrame:
    """(c, n, s, q1, q2, q3) of classes (c, n, last, shared): s of their tokens other classes have too; of these the first under the three orders.

    last is the last of the first tokens by hash; shared has the (count, token) that others hold too.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, last = (np.asarray(batch.column(k)) for k in (1, 2))
            lists = batch.column(3)
            counts = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            flat = lists.flatten()
            times, tokens = np.asarray(flat.field(0)), np.asarray(flat.field(1))
            owner = np.repeat(np.arange(len(n)), counts)
            quota = np.maximum(_prefix(n, percent) - (n - counts), 0)  # tokens of their own come first
            out = [batch.column(0), batch.column(1), pa.array(counts)]
            mine = tokens <= last[owner]
            out.append(_lists(tokens[mine], np.bincount(owner[mine], minlength=len(n))))
            for seed in (1, 2):
                order = np.lexsort((mixed(tokens.astype(np.uint64), seed), times, owner))
                first = order[_within(counts) < quota[owner]]
                out.append(_lists(tokens[first], np.minimum(quota, counts)))
            yield pa.RecordBatch.from_arrays(out, ["c", "n", "s", "q1", "q2", "q3"]).filter(pa.array(quota > 0))

    return held.select("c", "n", "last", "shared").mapInArrow(each, "c long, n long, s long, q1 array<long>, q2 array<long>, q3 array<long>")


def _alike(percent: int, nx: str, sx: str, ny: str, sy: str) -> str:
    """Whether two sets of n tokens, s of which others have too, can be alike at all: they have least(s) tokens in common at most."""
    return f"100 * least({sx}, {sy}) >= {percent} * ({nx} + {ny} - least({sx}, {sy}))"


def _links(pairs: DataFrame, prefixes: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that are alike: first by size and by the orders under which they did not meet, then by their sets."""
    p = lambda k: prefixes.select(F.col("c").alias(k), F.col("n").alias(f"n{k}"), F.col("s").alias(f"s{k}"), F.col("q1").alias(f"q1{k}"), F.col("q3").alias(f"q3{k}"))
    s = lambda k: classes.select(F.col("c").alias(k), F.col("tokens").alias(f"t{k}"))
    near = pairs.join(p("x"), "x").join(p("y"), "y").where(_alike(percent, "nx", "sx", "ny", "sy")).where(F.arrays_overlap("q1x", "q1y") & F.arrays_overlap("q3x", "q3y")).select("x", "y", "nx", "ny")
    both = near.join(s("x"), "x").join(s("y"), "y").withColumn("o", F.size(F.array_intersect("tx", "ty")))
    return both.where(f"100 * o >= {percent} * (nx + ny - o)").select("x", "y")


def _ordered(x: Column | str, y: Column | str) -> list[Column]:
    return [F.least(x, y).alias("x"), F.greatest(x, y).alias("y")]


def near_sets(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(number.alias("number"), F.xxhash64("text").alias("key"), "text")
    own = written(_sets(rows, size, percent, False), "sets")

    # Sets that share enough of their first tokens by hash with others, and one row of each.
    first = own.select("f1", "f2", "n", F.explode("tokens").alias("token"))
    shared = written(first.groupBy("token").agg(F.min("f1").alias("a"), F.max("f1").alias("b")).where("a != b").select("token"), "sets")
    least = own.groupBy("f1", "f2").agg(F.min(F.struct("number", "key")).alias("m"), F.min(F.expr(f"nullif(number, {-(1 << 63)})")).alias("least_id"), F.count("*").alias("copies"))
    found = first.join(shared, "token").groupBy("f1", "f2", "n").agg(F.count("*").alias("found"))
    enough = F.expr(f"(((n * {percent} + 99) div 100) + 9) div 10")
    some = written(found.join(least.select("f1", "f2", "copies"), ["f1", "f2"]).where(F.col("found") >= enough * F.col("copies")).select("f1", "f2"), "sets")
    picked = least.join(some, ["f1", "f2"]).select("m.number", "m.key").distinct()
    texts = rows.join(picked, ["number", "key"]).groupBy("number", "key").agg(F.first("text").alias("text"))
    classes = written(with_ids(_sets(texts, size, percent, True).select("f1", "f2", "n", "tokens").dropDuplicates(["f1", "f2"]), "sets", "c"), "sets")

    # The orders that need counts.
    held = classes.select("c", F.explode("tokens").alias("token"))
    counts = held.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    lists = held.join(counts, "token").groupBy("c").agg(F.collect_list(F.struct("times", "token")).alias("shared"))
    last = classes.select("c", "n", F.expr(f"element_at(tokens, cast(n - ((n * {percent} + 99) div 100) + 1 AS int))").alias("last"))
    prefixes = written(_prefixes(lists.join(last, "c"), percent), "sets")

    # Each class against two of those that it meets: the one that shares most of its tokens, as the middle of a crowd does, and any.
    # left: its tokens from this one on that others have too; what two sets have in common begins with the first token where they meet.
    meets = prefixes.select("c", "n", "s", F.posexplode("q2").alias("place", "token")).withColumn("left", F.col("s") - F.col("place")).drop("place")
    spread = F.pmod(F.xxhash64("c"), F.lit(1 << 20))
    middle = F.floor(F.col("s") * (1 << 20) / F.col("n")) * (1 << 20) + spread
    leaders = meets.groupBy("token").agg(F.max_by("c", middle).alias("l1"), F.min_by("c", spread).alias("l2"), F.count("*").alias("crowd")).where("crowd > 1")
    star = meets.join(leaders, "token").select("c", F.explode(F.array("l1", "l2")).alias("l")).where("c != l").select(*_ordered("c", "l")).distinct()
    star = written(star, "sets")
    links = written(_links(star, prefixes, classes, percent), "sets")

    # Then pairs of different groups that met.
    roots = connected(links, "x", "y")
    grouped = written(meets.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c")), "sets")
    mixed_tokens = grouped.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("token")
    among = grouped.join(mixed_tokens, "token")
    other = among.select("token", F.col("c").alias("d"), F.col("n").alias("m"), F.col("left").alias("right"), F.col("root").alias("other"))
    cross = among.join(other, "token").where(f"root < other AND {_alike(percent, 'n', '`left`', 'm', '`right`')}").select(*_ordered("c", "d")).distinct()
    more = written(_links(cross.join(star, ["x", "y"], "left_anti"), prefixes, classes, percent), "sets")
    roots = connected(links.unionAll(more), "x", "y")

    named = classes.select("c", "f1", "f2").join(roots.withColumnRenamed("node", "c"), "c").select("f1", "f2", "root")
    full = least.join(named, ["f1", "f2"], "left")
    tops = full.where("root IS NOT NULL").groupBy("root").agg(F.min("least_id").alias("top"))
    names = written(full.join(tops, "root", "left").select("f1", "f2", F.expr("CASE WHEN root IS NULL THEN least_id ELSE top END").alias("component_id")), "sets")
    drop_written(some, shared, star, grouped)

    own_id = F.expr(f"nullif(number, {-(1 << 63)})")
    linked = own.where("n > 0").join(names, ["f1", "f2"]).select(own_id.alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(own.where("n = 0").select(own_id.alias("doc_id"), F.col("n").alias("n_shingles"), own_id.alias("component_id")))
