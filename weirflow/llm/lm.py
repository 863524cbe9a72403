"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

P(token | context) = P(group | context) * P(class | group, context) * P(token | class, token before).

* A token's class is its own for the most frequent tokens and a hash of its last
  bytes for the others; eight classes are a group.
* P(group | context) and P(class | group, context) are softmaxes over sums of
  weight rows of hashed features: the tokens one, two and three back (skip
  features), the pair of the last two, and a bias.
* P(token | class, token before) is a softmax over all tokens of the class: the
  token's share of its class's training tokens (with absolute discounting; what
  the discount frees is the share of tokens that training has not seen) times
  exp(weight).  The weight belongs to the pair of the hashed token before (its
  cell) and the token: pairs that training has not seen weigh 0, the others are
  tied by how far their count exceeds what the two frequencies let expect.
  The sum over the class, seen pairs apart, is known in closed form, so the
  softmax is exact over the whole vocabulary.

What is gathered grows with the corpus: counts of all tokens and of all pairs of
a cell and a token, exact and over all training documents.  Each range of
documents sends its distinct tokens and pairs (64-bit hashes) with their counts
to hash buckets, which send back the totals of just what the range asked for, so
no task needs the vocabulary.  Rows that travel are one for each range and
bucket; buckets come in multiples of ``LANES`` and hold one entry at least, so
these rows grow with the ranges, and never beyond the entries.

A range's rows are read once more to learn and to score; it finds its own keys
again, so answers carry counts alone.

The context weights (2 tables of 2**bits rows of 8) are trained on all training
documents: each range takes gradient steps (AdaGrad, per weight row) through its
documents in a fixed order, and the ranges' weights are averaged in proportion to
their tokens, by groups of ``FAN`` in as many rounds as it takes.  The pairs'
weights follow by iterative scaling from sums over all ranges; there each
training token is left out of its own pair's count.  Ranges depend on the rows
alone, so scores do not depend on how the table is stored.

Tokens are words (anything but 0x20 and 0x09-0x0D; A-Z lower-cased) and one end
per document.  Defined results: null text is empty and so has the end alone; a
null doc_id is learnt from; repeated rows count and are scored each (those so
many that they would crowd a range are worked on once, with their number as
weight); a long text is read in pieces that end before white space; without
training documents every token is unseen with probability 1 / 2 in the base and
the model stays uniform; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import chunks, drop_written, free_shuffles, held_apart, long_pieces, small_batches, text_bytes, trim, written

_FOLD = bytes(32 if c in b" \t\n\r\x0b\x0c" else c + 32 if 65 <= c <= 90 else c for c in range(256))
END = b"\n"  # no word has it
_START = np.uint64(0x5851F42D4C957F2D)
_ODDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
#: Classes of a group, and groups.
WIDE = 8
#: Tokens back that features look.
BACK = 3
#: Hash buckets come in multiples of this.
LANES = 64
#: Blobs that are combined at once.
FAN = 8
#: Text bytes of equal rows from which on they are worked on once.
CROWD_BYTES = 2 << 20
PIECE_BYTES = 1 << 20


@dataclass(frozen=True)
class MaxEnt:
    #: Each table of context weights has 2**bits rows of WIDE numbers; a fixed size, whatever the corpus.
    bits: int = 15
    #: Classes of one frequent token each, of WIDE * WIDE.
    own: int = 16
    suffix: int = 3
    #: Tokens before are hashed to 2**cell_bits cells where they are paired with a token.
    cell_bits: int = 10
    #: Weights of pairs: by the excess of their count in powers of 4, after the weight of none.
    excess: int = 12
    rounds: int = 60
    rate: float = 0.5
    batch: int = 16384
    #: Text bytes for each range of documents.
    range_bytes: int = 24 << 20

    @property
    def classes(self) -> int:
        return WIDE * WIDE


# -- tokens -------------------------------------------------------------------------------------------------------


def tokens(column: pa.Array, ended: np.ndarray | None = None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct tokens, code of each token in order, tokens per row), END last in each row (of those in ended)."""
    data, offsets = text_bytes(column)
    folded = data.tobytes().translate(_FOLD)
    lists = pc.split_pattern(pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(folded)]), b" ")
    coded = pc.dictionary_encode(lists.values)
    known = coded.dictionary.to_pylist()
    code = np.asarray(coded.indices)
    filled = np.fromiter(map(len, known), np.int64, len(known))[code] > 0 if len(code) else np.zeros(0, bool)
    words = np.concatenate([[0], np.cumsum(filled)])[np.asarray(lists.offsets)]
    ended = np.ones(len(column), bool) if ended is None else ended
    sizes = np.diff(words) + ended
    out = np.full(int(sizes.sum()), len(known), np.int64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes)[ended] - 1] = False
    out[inner] = code[filled]
    return [*known, END], out, sizes


def hashes(known: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))


def suffix_classes(known: list[bytes], model: MaxEnt) -> np.ndarray:
    import xxhash

    n = model.suffix
    return model.own + np.fromiter((xxhash.xxh32_intdigest(w[-n:]) for w in known), np.int64, len(known)) % (model.classes - model.own)


@dataclass
class Block:
    """Tokens of some rows, or of a piece of one."""

    known: list[bytes]
    known_h: np.ndarray
    code: np.ndarray
    sizes: np.ndarray
    #: The row of each run of tokens.
    rows: np.ndarray
    #: Hashes of the last BACK tokens before the first run.
    before: np.ndarray

    @property
    def h(self) -> np.ndarray:
        return self.known_h[self.code]

    @property
    def present(self) -> np.ndarray:
        return np.bincount(self.code, minlength=len(self.known)) > 0

    def back(self, most: int = BACK) -> list[np.ndarray]:
        """Hashes of the tokens 1, 2, ... back, for each token."""
        h, begin, found = self.h, np.cumsum(self.sizes) - self.sizes, []
        for k in range(1, most + 1):
            b = np.full(len(h), _START, np.uint64)
            b[k:] = h[:-k]
            for d in range(k):
                b[begin[self.sizes > d] + d] = _START
            n = min(k, int(self.sizes[0]))
            b[:n] = self.before[BACK - k : BACK - k + n]
            found.append(b)
        return found


def blocks(column: pa.Array, most: int = 2 * PIECE_BYTES) -> Iterator[Block]:
    """The tokens of a column in order; a later piece of a text knows the tokens before it."""
    pieces, counts = long_pieces(column, PIECE_BYTES)
    counts = np.ones(len(column), np.int64) if counts is None else counts
    owner = np.repeat(np.arange(len(column)), counts)
    last = np.zeros(len(owner), bool)
    last[np.cumsum(counts) - 1] = True
    start = np.full(BACK, _START, np.uint64)
    at, tail = 0, start
    for batch in chunks([pa.RecordBatch.from_arrays([pieces], ["text"])], 0, most):
        here = owner[at : at + batch.num_rows]
        known, code, sizes = tokens(batch.column(0), last[at : at + batch.num_rows])
        # Pieces of one text within a block are one run.
        head = np.concatenate([[True], np.diff(here) > 0])
        run = np.add.reduceat(sizes, np.flatnonzero(head))
        before = tail if at and owner[at] == owner[at - 1] else start
        block = Block(known, hashes(known), code.astype(np.int32), run, here[head], before)
        tail = np.concatenate([before if len(run) == 1 else start, block.h[len(code) - int(run[-1]) :]])[-BACK:]
        yield block
        at += batch.num_rows


def features(back: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Row numbers of the weights for each token's context: one, two and three back, and the pair of the last two."""
    shift = np.uint64(64 - bits)
    rows = [((b * odd) ^ (b >> np.uint64(29))) * _ODDS[4] >> shift for b, odd in zip(back, _ODDS, strict=False)]
    rows.append((back[0] * _ODDS[3] + back[1]) * _ODDS[4] >> shift)
    return [r.astype(np.int32) for r in rows]


def within(rows: list[np.ndarray], group: np.ndarray, bits: int) -> list[np.ndarray]:
    """The same features in the table of P(class | group)."""
    mixed = ((group.astype(np.int64) + 1) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits)
    return [r ^ mixed.astype(np.int32) for r in rows]


def cells(back: np.ndarray, model: MaxEnt) -> np.ndarray:
    return ((back * _ODDS[1]) >> np.uint64(64 - model.cell_bits)).astype(np.int64)


def pair_keys(h: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """A hash of 63 bits of the pair of a token and the cell of the one before."""
    x = (h ^ ((cell.astype(np.uint64) + np.uint64(1)) * _ODDS[2])) * _ODDS[4]
    return (x ^ (x >> np.uint64(31))) * _ODDS[0] >> np.uint64(1)


# -- context weights ----------------------------------------------------------------------------------------------


def softmax(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """(WIDE, tokens) from weights (WIDE, 2**bits)."""
    z = weights.take(rows[0], axis=1)
    for r in rows[1:]:
        z += weights.take(r, axis=1)
    z += bias[:, None]
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)
    return z


class Learner:
    """AdaGrad with one rate for each weight row; table 0 chooses the group, table 1 the class in it."""

    def __init__(self, model: MaxEnt):
        self.model = model
        self.weights = np.zeros((2, WIDE, 1 << model.bits), np.float32)
        self.bias = np.zeros((2, WIDE), np.float32)
        self.seen, self.seen_bias, self.tokens = np.zeros((2, 1 << model.bits), np.float32), [1e-6, 1e-6], 0

    def step(self, rows: list[np.ndarray], labels: np.ndarray, times: np.ndarray | None = None) -> None:
        """One update by some tokens; times: how often each counts."""
        group = labels // WIDE
        for table, own, label in ((0, rows, group), (1, within(rows, group, self.model.bits), labels % WIDE)):
            g = softmax(self.weights[table], self.bias[table], own)
            g[label, np.arange(len(labels))] -= 1
            if times is not None:
                g *= times
            at = np.concatenate(own)
            total = np.empty_like(self.weights[table])
            for c in range(WIDE):
                total[c] = np.bincount(at, np.tile(g[c], len(own)), 1 << self.model.bits)
            self.seen[table] += np.einsum("ij,ij->j", total, total)
            total *= self.model.rate / np.sqrt(self.seen[table] + 1e-6)
            self.weights[table] -= total
            total = g.sum(axis=1)
            self.seen_bias[table] += float(total @ total)
            self.bias[table] -= total * (self.model.rate / math.sqrt(self.seen_bias[table]))
        self.tokens += len(labels) if times is None else int(times.sum())


def class_log10(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, model: MaxEnt) -> np.ndarray:
    """log10 P(class | context) of each token."""
    group, out = labels // WIDE, np.zeros(len(labels))
    for table, own, label in ((0, rows, group), (1, within(rows, group, model.bits), labels % WIDE)):
        for i in range(0, len(labels), model.batch):
            p = softmax(weights[table], bias[table], [r[i : i + model.batch] for r in own])
            out[i : i + model.batch] += np.log10(np.maximum(p[label[i : i + model.batch], np.arange(p.shape[1])], 1e-30))
    return out


def class_of(known: list[bytes], h: np.ndarray, frequent: np.ndarray, model: MaxEnt) -> np.ndarray:
    """frequent: hashes of the tokens with a class of their own, in the classes' order."""
    found = suffix_classes(known, model)
    if len(frequent):
        order = np.argsort(frequent)
        at = np.minimum(np.searchsorted(frequent[order], h), len(frequent) - 1)
        own = frequent[order][at] == h
        found[own] = order[at[own]]
    return found


# -- counts -------------------------------------------------------------------------------------------------------


def _rows(table: pa.Table) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Batches of a range's rows (part, trains, text, key, times, ...) in a fixed order, with whether each trains and how often it counts."""
    order = np.lexsort((np.asarray(table.column("key")), np.asarray(pc.binary_length(table.column("text")))))
    ordered = table.take(pa.array(order))
    for batch in chunks(ordered.combine_chunks().to_batches(), 2):
        yield batch, np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).astype(bool), np.asarray(batch.column(4)).astype(np.int64)


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of their weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat(weights[order], start)


def _counted_ones(keys: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for weights of 0 and 1: one sort of keys that carry them in a last bit (keys are of 63 bits)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    both = np.sort((keys << np.uint64(1)) | ones.astype(np.uint64))
    keys = both >> np.uint64(1)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat((both & np.uint64(1)).astype(np.int64), start)


def _pieces_by(cuts: np.ndarray, *arrays: np.ndarray) -> Iterator[list[bytes]]:
    edges = [0, *cuts.tolist(), len(arrays[0])]
    for s, e in zip(edges, edges[1:], strict=False):
        yield [a[s:e].tobytes() for a in arrays] if e > s else [b""] * len(arrays)


def _borders(buckets: int, bits: int) -> np.ndarray:
    return (np.arange(1, buckets).astype(object) * (1 << bits) // buckets).astype(np.uint64) if buckets > 1 else np.zeros(0, np.uint64)


_ASKED = "bucket int, part int, hashes binary, counts binary, classes binary, pairs binary, pair_counts binary"


def _asked(buckets: int, model: MaxEnt):
    """A range's distinct tokens (hashes, training counts, suffix classes) and pairs (keys, training counts), by bucket."""

    def each(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        found, pairs = [], []
        for batch, trains, times in _rows(table):
            for b in blocks(batch.column(2)):
                weight = np.where(trains, times, 0)[b.rows]
                each_ = np.repeat(weight, b.sizes)
                counts = np.bincount(b.code, each_, len(b.known)).astype(np.int64)
                present = b.present
                found.append((b.known_h[present], counts[present], suffix_classes(b.known, model)[present]))
                keys = pair_keys(b.h, cells(b.back(1)[0], model))
                pairs.append(_counted_ones(keys, each_) if weight.max(initial=0) <= 1 else _counted(keys, each_))
        h, first, inverse = np.unique(np.concatenate([f[0] for f in found]), return_index=True, return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([f[1] for f in found]), len(h)).astype("<u8")
        classes = np.concatenate([f[2] for f in found])[first].astype("<u2")
        keys, pair_counts = _counted(np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs]))
        of_tokens = _pieces_by(np.searchsorted(h, _borders(buckets, 64)), h, counts, classes)
        of_pairs = _pieces_by(np.searchsorted(keys, _borders(buckets, 63)), keys, np.minimum(pair_counts, (1 << 31) - 1).astype("<u4"))
        rows = [(i, part, *t, *p) for i, (t, p) in enumerate(zip(of_tokens, of_pairs, strict=True)) if t[0] or p[0]]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "part", "hashes", "counts", "classes", "pairs", "pair_counts"])

    return lambda table: (each(table), trim())[0]


_ANSWERED = "part int, bucket int, counts binary, pair_counts binary, stats binary"
_OWNER = np.uint16(1 << 15)


def short(counts: np.ndarray) -> np.ndarray:
    """Counts as the upper half of a 32-bit float: exact to 256, else to 8 bits; the top bit stays free."""
    return (np.asarray(counts, "<f4").view("<u4") >> np.uint32(16)).astype("<u2")


def long(counts: np.ndarray) -> np.ndarray:
    return ((counts & ~_OWNER).astype("<u4") << np.uint32(16)).view("<f4").astype(np.int64)


def _answered(model: MaxEnt):
    """A bucket's totals: one row for each range that asked, in the order of what it asked, and one (part -1) with the bucket's statistics.

    The first range that asked for a pair owns it (the top bit of its count).
    """

    def each(table: pa.Table) -> pa.Table:
        parts, bucket = table.column("part").to_pylist(), table.column("bucket")[0].as_py()
        read = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
        asked, counts, classes = read("hashes", "<u8"), read("counts", "<u8"), read("classes", "<u2")
        h, first, inverse = np.unique(np.concatenate(asked), return_index=True, return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts).astype(np.float64), len(h)).astype("<u8")
        edges = np.cumsum([0, *map(len, asked)])
        keys = read("pairs", "<u8")
        ends = np.cumsum([0, *map(len, keys)])
        own = np.concatenate(keys)
        order = np.argsort(own, kind="stable")  # stable: the first range that asked comes first
        new = np.concatenate([[True], own[order][1:] != own[order][:-1]])[: len(own)]
        sums = np.add.reduceat(np.concatenate(read("pair_counts", "<u4")).astype(np.int64)[order], np.flatnonzero(new)) if len(own) else np.zeros(0, np.int64)
        reply = np.empty(len(own), "<u2")
        reply[order] = short(sums)[np.cumsum(new) - 1] | np.where(new, _OWNER, np.uint16(0))
        rows = [(p, bucket, total[inverse[edges[i] : edges[i + 1]]].tobytes(), reply[ends[i] : ends[i + 1]].tobytes(), None) for i, p in enumerate(parts)]
        rows.append((-1, bucket, None, None, _statistics(h, total, np.concatenate(classes)[first] if len(h) else np.zeros(0, "<u2"), model)))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 3]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "bucket", "counts", "pair_counts", "stats"])

    return lambda table: (each(table.sort_by("part")), trim())[0]


def _statistics(h: np.ndarray, total: np.ndarray, of: np.ndarray, model: MaxEnt) -> bytes:
    """The most frequent tokens (hash, count, class), then by class tokens and types, tokens seen once and twice, tokens after each cell."""
    seen = total > 0
    top = np.lexsort((h, np.iinfo(np.int64).max - total.astype(np.int64)))[: model.own]
    top = top[total[top] > 0]
    head = np.zeros((3, model.own), "<u8")
    head[:, : len(top)] = h[top], total[top], of[top]
    ends = h == hashes([END])[0]
    cell = cells(np.where(ends, _START, h), model)  # what follows an end is a start
    sums = [np.bincount(of[seen], total[seen].astype(np.float64), model.classes), np.bincount(of[seen], minlength=model.classes), [(total == 1).sum(), (total == 2).sum()], np.bincount(cell, total.astype(np.float64), 1 << model.cell_bits)]
    return head.tobytes() + np.concatenate(sums).astype("<f8").tobytes()


def _add_statistics(blobs: list[bytes], model: MaxEnt) -> bytes:
    cut = 3 * model.own * 8
    heads = np.concatenate([np.frombuffer(b[:cut], "<u8").reshape(3, -1) for b in blobs], axis=1)
    order = np.lexsort((heads[0], np.iinfo(np.int64).max - heads[1].astype(np.int64)))[: model.own]
    return np.ascontiguousarray(heads[:, order]).tobytes() + sum(np.frombuffer(b[cut:], "<f8") for b in blobs).tobytes()


def _tree(blobs: DataFrame, count: int, combine) -> DataFrame:
    """blobs (id int, n long, blob binary) down to one row, by combine(blobs, ns) of FAN rows at once."""

    def each(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("id").to_pylist(), table.column("n").to_pylist(), table.column("blob").to_pylist(), strict=True), key=lambda r: r[0])
        return pa.table({"id": pa.array([rows[0][0] // FAN], pa.int32()), "n": [sum(r[1] for r in rows)], "blob": pa.array([combine([r[2] for r in rows], [r[1] for r in rows])], pa.binary())})

    while count > 1:
        blobs = blobs.withColumn("at", F.floor(F.col("id") / FAN).cast("int")).groupBy("at").applyInArrow(lambda t: each(t.drop_columns(["at"])), "id int, n long, blob binary")
        count = -(-count // FAN)
    return blobs


@dataclass
class Totals:
    tokens: int
    types: int
    frequent: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray
    discount: float
    after: np.ndarray


def _totals(blob: bytes, model: MaxEnt) -> Totals:
    cut = 3 * model.own * 8
    top = np.frombuffer(blob[:cut], "<u8").reshape(3, -1)
    frequent = [(int(h), int(c), int(of)) for h, c, of in top.T if c]
    sums = np.frombuffer(blob[cut:], "<f8")
    stats, ones, after = sums[: 2 * model.classes].reshape(2, -1).copy(), sums[2 * model.classes : 2 * model.classes + 2], sums[2 * model.classes + 2 :]
    tokens_, types = int(stats[0].sum()), int(stats[1].sum())
    for k, (_, count, of) in enumerate(frequent):
        stats[0, of] -= count
        stats[1, of] -= 1
        stats[0, k], stats[1, k] = count, 1
    discount = float(min(max(ones[0] / max(ones[0] + 2 * ones[1], 1), 0.1), 0.95))
    return Totals(tokens_, types, np.array([f[0] for f in frequent], np.uint64), stats[0], stats[1], discount, after)


# -- tokens within a class ----------------------------------------------------------------------------------------


def shares(count: np.ndarray, of: np.ndarray, t, model: MaxEnt) -> np.ndarray:
    """Each token's share of its class (of); count 0: the share of all unseen tokens together."""
    lone = np.arange(model.classes) < len(t.frequent)
    discount = np.where(lone, 0.0, t.discount)
    safe = np.maximum(t.class_tokens, 1)
    unseen = np.where(t.class_tokens > 0, np.where(lone, 1e-12, np.maximum(discount * t.class_types, 1e-3) / safe), 1.0)
    return np.where(count > 0, np.maximum(count - discount[of], 1e-3) / safe[of], unseen[of])


def excess(pairs: np.ndarray, count: np.ndarray, cell: np.ndarray, t, model: MaxEnt) -> np.ndarray:
    """The weight that a pair has: 0 for a pair not seen, else by how far its count exceeds the expected one, in powers of 4."""
    expected = np.maximum(t.after[cell], 1) * np.maximum(count, 1) / max(t.tokens, 1)
    return np.where(pairs > 0, np.clip(np.floor(np.log2(np.maximum(pairs, 1) / expected) / 2) + model.excess // 3, 0, model.excess - 1).astype(np.int64) + 1, 0)


def fitted(mass: np.ndarray, of_tokens: np.ndarray, seen: np.ndarray, rounds: int) -> np.ndarray:
    """Weights (the first 0) by iterative scaling: mass (excess + 1, contexts), tokens of each context, tokens of each weight."""
    theta = np.zeros(len(seen))
    live = np.flatnonzero(of_tokens > 0)
    mass, of_tokens = mass[:, live], of_tokens[live]
    for _ in range(rounds):
        each = np.exp(theta)[:, None] * mass
        expected = (each * (of_tokens / np.maximum(each.sum(axis=0), 1e-12))).sum(axis=1)
        theta += np.clip(np.log((seen + 0.5) / (expected + 0.5)), -2, 2)
        theta = np.clip(theta - theta[0], -20, 20)
    return theta


class Known:
    """A range's blocks with the answers: totals of its tokens and pairs."""

    def __init__(self, table: pa.Table, answers: pa.Table, model: MaxEnt):
        #: (rows, whether each trains, how often each counts, blocks)
        self.read = [(batch, trains, times, list(blocks(batch.column(2)))) for batch, trains, times in _rows(table)]
        every = [b for *_, bs in self.read for b in bs]
        self.hashes = np.unique(np.concatenate([b.known_h[b.present] for b in every]))
        pairs = np.concatenate([pair_keys(b.h, cells(b.back(1)[0], model)) for b in every])
        pairs.sort()
        self.pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
        answers = answers.sort_by("bucket")  # buckets are ranges of keys, answers come in the order of what was asked
        read = lambda name, kind: np.frombuffer(b"".join(answers.column(name).to_pylist()), kind)
        self.counts, replies = read("counts", "<u8"), read("pair_counts", "<u2")
        self.owned, self.pair_counts = replies >= _OWNER, replies

    def of_tokens(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.counts[at], 0).astype(np.int64)

    def places(self, keys: np.ndarray) -> np.ndarray:
        # In order, as neighbours are found faster than places by chance.
        order, found = np.argsort(keys), np.empty(len(keys), np.int64)
        found[order] = np.searchsorted(self.pairs, keys[order])
        return found


def _learnt(sent, model: MaxEnt):
    """A range's context weights, and its sums for the weights of pairs: one row."""
    width, contexts = model.excess + 1, model.classes << model.cell_bits

    def each(table: pa.Table, answers: pa.Table) -> pa.Table:
        t = SimpleNamespace(**sent.value)
        known, learner = Known(table, answers, model), Learner(model)
        mass, of_tokens, seen = np.zeros((model.excess, contexts), np.float32), np.zeros(contexts), np.zeros(width)
        done = ~known.owned  # pairs whose share is another range's to add, or added
        for _, trains, times, own_blocks in known.read:
            for b in own_blocks:
                count = known.of_tokens(b.known_h)
                of = class_of(b.known, b.known_h, t.frequent, model)
                share = shares(count, of, t, model)
                back = b.back()
                cell = cells(back[0], model)
                at = known.places(pair_keys(b.h, cell))
                pairs = long(known.pair_counts[at])
                labels, count = of[b.code], count[b.code]
                context = (labels << model.cell_bits) | cell
                # Each pair's share, once.
                todo = np.flatnonzero(~done[at] & (pairs > 0))
                _, first = np.unique(at[todo], return_index=True)
                todo = todo[first]
                kind = excess(pairs[todo], count[todo], cell[todo], t, model)
                mass += np.bincount((kind - 1) * contexts + context[todo], share[b.code[todo]], model.excess * contexts).reshape(mass.shape)
                done[at] = True
                # Training tokens, each left out of its own counts; one that is alone with its kind is unseen then.
                weight = np.repeat(np.where(trains, times, 0)[b.rows], b.sizes)
                keep = np.flatnonzero(weight)
                left = keep[count[keep] > weight[keep]]
                kind = excess(pairs[left] - weight[left], count[left] - weight[left], cell[left], t, model)
                seen += np.bincount(kind, weight[left], width)
                of_tokens += np.bincount(context[left], weight[left], contexts)
                for i in range(0, len(keep), model.batch):
                    own = keep[i : i + model.batch]
                    learner.step(features([x[own] for x in back], model.bits), labels[own], None if (weight[own] == 1).all() else weight[own])
        blob = learner.weights.tobytes() + learner.bias.tobytes() + mass.tobytes() + of_tokens.tobytes() + seen.tobytes()
        return pa.table({"id": pa.array([table.column("part")[0].as_py()], pa.int32()), "n": [learner.tokens], "blob": pa.array([blob], pa.binary())})

    return lambda table, answers: (each(table, answers), trim())[0]


def _cut_blob(blob: bytes, model: MaxEnt) -> list[np.ndarray]:
    contexts = model.classes << model.cell_bits
    kinds = ((2 * WIDE << model.bits, "<f4"), (2 * WIDE, "<f4"), (model.excess * contexts, "<f4"), (contexts, "<f8"), (model.excess + 1, "<f8"))
    found, at = [], 0
    for n, kind in kinds:
        found.append(np.frombuffer(blob, kind, n, at))
        at += found[-1].nbytes
    return found


def _add_blobs(blobs: list[bytes], ns: list[int], model: MaxEnt) -> bytes:
    """Weights averaged by tokens, sums added."""
    total, out = max(sum(ns), 1), None
    for blob, n in zip(blobs, ns, strict=True):
        own = _cut_blob(blob, model)
        own = [x * np.float32(n / total) if k < 2 else x for k, x in enumerate(own)]
        out = own if out is None else [a + b for a, b in zip(out, own, strict=True)]
    return b"".join(x.tobytes() for x in out)


# -- scores -------------------------------------------------------------------------------------------------------


def _scored(sent, model: MaxEnt):
    def each(table: pa.Table, answers: pa.Table) -> pa.Table:
        t = SimpleNamespace(**sent.value)
        known, out = Known(table, answers, model), []
        for batch, trains, times, own_blocks in known.read:
            n = batch.num_rows
            sums = np.zeros((4, n))
            for b in own_blocks:
                count = known.of_tokens(b.known_h)
                of = class_of(b.known, b.known_h, t.frequent, model)
                base = np.log10((count + 1) / (t.tokens + t.types + 1))
                share = np.log10(shares(count, of, t, model))
                back = b.back()
                cell = cells(back[0], model)
                kind = excess(long(known.pair_counts[known.places(pair_keys(b.h, cell))]), count[b.code], cell, t, model)
                labels = of[b.code]
                inside = share[b.code] + (t.theta[kind] - t.log_z[(labels << model.cell_bits) | cell]) / math.log(10)
                outside = class_log10(t.weights, t.bias, features(back, model.bits), labels, model)
                starts = np.cumsum(b.sizes) - b.sizes
                for k, x in enumerate((np.ones(len(labels)), (count > 0)[b.code], base[b.code], inside + outside)):
                    np.add.at(sums[k], b.rows, np.add.reduceat(x.astype(np.float64), starts))
            whole = sums[:2].astype(np.int64)
            out.append(pa.RecordBatch.from_arrays([batch.column(5), pa.array(~trains), pa.array(whole[0]), pa.array(whole[1]), pa.array(np.full(n, t.tokens)), pa.array(sums[2]), pa.array(sums[3]), pa.array(times)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "times"]))
        return pa.Table.from_batches(out)

    return lambda table, answers: (each(table, answers), trim())[0]


def scores(docs: DataFrame, model: MaxEnt = MaxEnt(), folds: int = 7, held: int = 2, crowd: int = CROWD_BYTES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = small_batches(docs).sparkSession
    own = docs.select(
        F.coalesce(held_apart("doc_id", folds) != held, F.lit(True)).alias("trains"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"),
        F.lit(1).cast("long").alias("times"),
        F.col("doc_id").cast("long").alias("doc_id"),
    )
    equal = own.groupBy("key").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).cast("long").alias("size"))
    crowded = (F.col("n") > 1) & (F.col("n") * F.greatest("size", F.lit(64)) > crowd)
    size, n_crowded = equal.agg(F.sum(F.when(crowded, F.col("size")).otherwise(F.col("n") * F.col("size"))), F.count_if(crowded)).first()
    parts = max(1, -(-(size or 0) // model.range_bytes))
    buckets = LANES * -(-parts // LANES)
    if n_crowded:
        keys = written(equal.where(crowded).select("key"), "crowded")
        keys = F.broadcast(keys) if n_crowded <= 100_000 else keys
        same = ["trains", "text", "key", "doc_id"]
        once = own.join(keys, "key", "left_semi").groupBy(*same).agg(F.count("*").alias("times"))
        own = own.join(keys, "key", "left_anti").select(*own.columns).unionByName(once.select(*own.columns))
    own = own.select(F.pmod("key", F.lit(parts)).cast("int").alias("part"), *own.columns)
    asked = own.groupBy("part").applyInArrow(_asked(buckets, model), _ASKED)
    answers = written(asked.groupBy("bucket").applyInArrow(_answered(model), _ANSWERED), "counts")
    del asked
    statistics = answers.where("part = -1").select(F.col("bucket").alias("id"), F.lit(1).cast("long").alias("n"), F.col("stats").alias("blob"))
    found = _tree(statistics, buckets, lambda blobs, ns: _add_statistics(blobs, model)).first()
    totals = _totals(found["blob"] if found else _statistics(*(np.zeros(0, k) for k in (np.uint64, np.uint64, np.int64)), model), model)
    replies = answers.where("part >= 0").select("part", "bucket", "counts", "pair_counts")
    sent = spark.sparkContext.broadcast(vars(totals))  # plain values: broadcasts are read without this package
    learnt = written(own.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_learnt(sent, model), "id int, n long, blob binary"), "weights")
    found = _tree(learnt, parts, lambda blobs, ns: _add_blobs(blobs, ns, model)).first()
    contexts = model.classes << model.cell_bits
    weights, bias, mass, of_tokens, seen = _cut_blob(found["blob"], model) if found else (np.zeros(n) for n in (2 * WIDE << model.bits, 2 * WIDE, model.excess * contexts, contexts, model.excess + 1))
    drop_written(learnt)
    mass = mass.reshape(model.excess, -1).astype(np.float64)
    # What no seen pair takes of a class is left to the others.
    mass = np.concatenate([np.maximum(1 - mass.sum(axis=0), 1e-9)[None], mass])
    theta = fitted(mass, of_tokens, seen, model.rounds)
    log_z = np.log((np.exp(theta)[:, None] * mass).sum(axis=0))
    context = {"weights": weights.reshape(2, WIDE, -1).astype(np.float32), "bias": bias.reshape(2, WIDE).astype(np.float32), "theta": theta, "log_z": log_z}
    trained = spark.sparkContext.broadcast(vars(totals) | context)
    free_shuffles(spark)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, times long"
    scored = own.groupBy("part").cogroup(replies.groupBy("part")).applyInArrow(_scored(trained, model), schema)
    return scored.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times") if n_crowded else scored.drop("times")
