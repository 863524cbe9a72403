"""Removal of long repeated substrings, by suffix sorting with prefix hashes.

A byte goes that lies in a string of ``length`` bytes which also starts in a
document with a smaller doc_id.  Five steps, all of them exact:

1. Anchors.  Equal strings of ``length`` bytes hold equal minimizers (the
   k-grams of least hash) at equal offsets, so it is enough to compare strings
   around minimizers: about one position in 15.  Hashes are polynomial, from
   prefix sums.
2. Distinct anchors of each range of documents meet by hash; those in one
   document only are of no interest.
3. The bytes around the others, ``length`` - k on both sides, are cut from the
   texts.  Of documents of one range with equal surroundings only the first
   sends them on (the rest is settled in step 5), so the copies of a hot
   passage shrink to one for each range before they are shuffled.  Around an
   anchor that occurs very often (``HOT``) each string is sent by itself, so
   that equal ones shrink likewise although their surroundings differ.
4. Surroundings meet by anchor.  Suffixes to the right of the anchor, and to
   its left, are sorted: a merge sort within each group of one anchor, in which
   suffixes are compared by the binary search for their common extension over
   prefix hashes.  Neighbours' extensions are verified on the bytes; on a hash
   collision the order is made anew from the bytes.  A string that starts j
   bytes before the anchor is known by the interval of suffixes that share its
   part right of the anchor, and that of its part left of it; the least doc_id
   of each class of strings decides.  Strings sent by themselves are groups of
   one hash, sorted in the same way.
5. Verdicts go back to the documents' range, where they are applied.

Entries travel as one row for each range and bucket.  Buckets come in multiples
of ``LANES``, so up to LANES * RANGE_BYTES of text these rows grow with the
ranges alone; beyond it a row still holds one entry at least, so they are never
more than the entries, which are a fixed part of the text.

A text of over ``SEGMENT_BYTES`` is dealt out in segments that share length - 1
bytes, so each string lies whole in one; a text that its doc_id has so often that
the copies would crowd a range (``CROWD_BYTES``) is looked at once for all of
them.  So no range holds much more than RANGE_BYTES.  What is removed comes
together again for one text at a time.

Texts are UTF-8 bytes.  Defined results: null text is empty; equal doc_ids are
not smaller than each other, so neither rows nor texts of one doc_id remove
each other's bytes; rows of null doc_id are left whole and remove nothing;
texts of fewer than ``length`` bytes are left whole; repeated rows have equal
results; an empty table gives an empty result; further columns are ignored, or
follow untouched where asked for.  Texts that lose part of a UTF-8 sequence
decode with what is left of it dropped (``deduplicated``); digests are of the
bytes.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weirflow.llm.common import chunks, column, segments, small_batches, text_bytes, trim, written

LENGTH = 50
GRAM = 20
#: Text bytes for each range of documents and each bucket of anchors.
RANGE_BYTES = 8 << 20
#: Buckets of anchors come in multiples of this.
LANES = 128
#: Text bytes of a segment of a long text, and of the rows of one doc_id and text that are looked at once.
SEGMENT_BYTES = 1 << 20
CROWD_BYTES = 2 << 20
#: Keys of such rows that are broadcast at most (16 bytes each).
BROADCAST_ROWS = 100_000
#: Occurrences of one anchor from which on the strings around it are compared one by one, with the same result.
HOT = 1 << 17
#: Bytes of text, and rows of surroundings, that a worker's arrays are made for at once: they are many times as large.
STEP_BYTES, STEP_ROWS = 1 << 18, 1 << 14
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _values() -> np.ndarray:
    return np.random.default_rng(1).integers(1, 1 << 62, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """p with (p[j] - p[i]) / base**i the polynomial hash, modulo 2**64, of data[i:j]; along the last axis."""
    found = np.zeros((*data.shape[:-1], data.shape[-1] + 1), np.uint64)
    values = _values()[data]
    values *= _powers(_ODD, data.shape[-1])[:-1]
    np.cumsum(values, axis=-1, out=found[..., 1:])
    return found


def _slide(f, a: np.ndarray, width: int) -> np.ndarray:
    """f (minimum or maximum) over each window of width."""
    step = 1
    while step * 2 <= width:
        a, step = f(a[:-step], a[step:]), step * 2
    return f(a[: len(a) - (width - step)], a[width - step :]) if step < width else a


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in the row's text, hash) of the minimizers of all strings of length bytes within rows."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64)
    prefix = prefix_hashes(data)
    hashes = (prefix[gram:] - prefix[:-gram]) * _powers(_INVERSE, len(data) - gram)
    order = hashes * _MIX
    order = (((order ^ (order >> np.uint64(32))) * _ODD) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _slide(np.minimum, order, length - gram + 1)
    for end in offsets[1:-1].tolist():  # strings that cross the border of two texts
        least[max(0, end - length + 1) : end] = 0
    edge = np.zeros(length - gram, np.uint32)
    at = np.flatnonzero(_slide(np.maximum, np.concatenate([edge, least, edge]), length - gram + 1) == order)
    row = np.searchsorted(offsets, at, side="right") - 1
    return row, at - offsets[row], hashes[at]


def _compare(prefix: np.ndarray, data: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(common extension, whether suffix a comes before b) for rows a, b of data, by binary search over prefix hashes."""
    low, high = np.zeros(len(a), np.int64), np.minimum(sizes[a], sizes[b])
    most = high.copy()
    while True:
        open_ = low < high
        if not open_.any():
            break
        middle = (low + high + 1) >> 1
        equal = prefix[a, middle] == prefix[b, middle]
        low, high = np.where(open_ & equal, middle, low), np.where(open_ & ~equal, middle - 1, high)
    ended = low == most
    last = data.shape[1] - 1
    before = np.where(ended, sizes[a] < sizes[b], data[a, np.minimum(low, last)] < data[b, np.minimum(low, last)])
    return low, before


def suffix_sort(data: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows by group, then by data[:size]; common extension of each with the one before, 0 at a group's start).

    group is ascending.  Bottom-up merge sort, all groups at once: an element's
    place in a merged run is its place in its own run plus the number of
    elements of the other run before it, found by binary search.
    """
    n = len(group)
    order = np.arange(n)
    if not n:
        return order, order
    prefix = prefix_hashes(data)
    start = np.searchsorted(group, group, side="left")
    size = np.searchsorted(group, group, side="right") - start
    within = np.arange(n) - start
    run = 1
    while True:
        live = np.flatnonzero(size > run)
        if not len(live):
            break
        mine = within[live] // run
        other = start[live] + np.minimum((mine ^ 1) * run, size[live])
        low, high = other, np.minimum(other + run, start[live] + size[live])
        high = np.maximum(low, high)
        left = (mine & 1) == 0
        base, me = low, order[live]
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) >> 1
            rival = order[middle]
            _, rival_first = _compare(prefix, data, sizes, np.where(left[open_], rival, me[open_]), np.where(left[open_], me[open_], rival))
            # left run: rivals strictly before me count; right run: rivals not after me
            counts = np.where(left[open_], rival_first, ~rival_first)
            low, high = low.copy(), high.copy()
            low[open_[counts]] = middle[counts] + 1
            high[open_[~counts]] = middle[~counts]
        to = start[live] + (mine >> 1) * 2 * run + within[live] % run + (low - base)
        order[to] = me
        run *= 2
    extension = np.zeros(n, np.int64)
    same = np.flatnonzero(group[1:] == group[:-1]) + 1  # group is the same for all that a place can hold
    hashed, _ = _compare(prefix, data, sizes, order[same - 1], order[same])
    differs = data[order[same - 1]] != data[order[same]]
    real = np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), data.shape[1]), np.minimum(sizes[order[same - 1]], sizes[order[same]]))
    extension[same] = real
    if (hashed != real).any():  # a collision of hashes: from the bytes
        order = np.lexsort((sizes, *data.T[::-1], group))
        differs = data[order[same - 1]] != data[order[same]]
        extension[same] = np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), data.shape[1]), np.minimum(sizes[order[same - 1]], sizes[order[same]]))
    return order, extension


# A document is known by its range (part) and its place there (ord): its rank by doc_id and hash of the text, which a
# recomputed task finds again.  Entries travel as blobs, one row for each range and bucket, one array for each column.
_ORD, _POS, _BYTE, _SMALL = np.dtype("<u4"), np.dtype("<u4"), np.dtype("u1"), np.dtype("i1")


def _trimmed(step):
    """step of one table, after which freed memory goes back to the system."""
    return lambda table: (step(table), trim())[0]


def _trimmed_pair(step):
    return lambda docs, found: (step(docs, found), trim())[0]


def _blobs(key: str, of: np.ndarray, part: int | None, columns: dict[str, np.ndarray]) -> pa.Table:
    """Entries as a row for each value of `of` (named key), with part if given."""
    order = np.argsort(of, kind="stable")
    found, starts = np.unique(of[order], return_index=True)
    edges = np.append(starts, len(order))
    rows = {key: pa.array(found, pa.int32())} | ({} if part is None else {"part": pa.array([part] * len(found), pa.int32())})
    for name, column in columns.items():
        column = np.ascontiguousarray(column[order])
        at = edges * (column.itemsize * (column.shape[1] if column.ndim > 1 else 1))
        if at[-1] >= 1 << 31:
            raise ValueError(f"{at[-1]} bytes of {name} in one task")
        rows[name] = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(column)])
    return pa.table(rows)


def _entries(table: pa.Table, **kinds: np.dtype) -> list[np.ndarray]:
    """The columns of entries of all rows of a table of blobs."""
    return [np.frombuffer(b"".join(table.column(name).to_pylist()), kind) for name, kind in kinds.items()]


def _part_of_entries(table: pa.Table, name: str, kind: np.dtype) -> np.ndarray:
    sizes = np.fromiter(map(len, table.column(name).to_pylist()), np.int64, table.num_rows) // kind.itemsize
    return np.repeat(np.asarray(table.column("part")).astype(np.int64), sizes)


def _flat(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _ordered(docs: pa.Table) -> np.ndarray:
    """Rows of a range (part, doc_id, hash, text, ...) in the order of their places."""
    return np.lexsort((np.asarray(docs.column(2)), np.asarray(docs.column(1))))


def _anchors_of(docs: pa.Table, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of all anchors of a range of documents."""
    texts = pa.RecordBatch.from_arrays([_flat(docs.column(3))], ["text"])
    found, before = [], 0
    for batch in chunks([texts], 0, STEP_BYTES):
        row, pos, h = anchors(*text_bytes(batch.column(0)), length, gram)
        found.append(((row + before).astype(np.int32), pos.astype(np.int32), h))
        before += batch.num_rows
    kinds = (np.int32, np.int32, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else tuple(np.zeros(0, k) for k in kinds)


def _anchors_out(parts: int, length: int, gram: int):
    """Step 1: the distinct anchors of a range, how often each occurs and whether in several documents, by bucket of the hash."""

    def each(docs: pa.Table) -> pa.Table:
        row, _, h = _anchors_of(docs, length, gram)
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        times = np.diff(np.append(start, len(h)))
        several = np.minimum.reduceat(row, start) != np.maximum.reduceat(row, start) if len(h) else np.zeros(0, bool)
        h = h[start]
        bucket = (h * _MIX >> np.uint64(40)).astype(np.int64) % parts
        return _blobs("bucket", bucket, docs.column(0)[0].as_py(), {"hash": h.astype("<u8"), "times": (times * 2 + several).astype("<u4")})

    return each


def _met(hot: int):
    """Step 2: of the anchors of a bucket those in several documents, for each range that has them; hot ones are marked."""

    def each(table: pa.Table) -> pa.Table:
        h, times = _entries(table, hash=np.dtype("<u8"), times=np.dtype("<u4"))
        part = _part_of_entries(table, "hash", np.dtype("<u8"))
        order = np.argsort(h, kind="stable")
        h, part, times = h[order], part[order], times[order].astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        size = np.diff(np.append(start, len(h)))
        if not len(h):
            return _blobs("part", part, None, {"hash": h, "hot": np.zeros(0, _BYTE)})
        several = (size > 1) | (times[start] & 1 == 1)
        many = np.add.reduceat(times >> 1, start) > hot
        kept = np.repeat(several, size)
        return _blobs("part", part[kept], None, {"hash": h[kept], "hot": np.repeat(many, size)[kept].astype(_BYTE)})

    return each


class _Surroundings:
    """The candidates of a range of documents with the bytes around them, equal surroundings by their first document.

    A candidate is an anchor that other documents have too.  In place of a hot
    one stand all strings of length bytes around it, each by itself (whole):
    equal strings of a range then shrink to one, so no group grows with the
    number of documents that have the anchor.
    """

    def __init__(self, docs: pa.Table, candidates: pa.Table, length: int, gram: int):
        side, self.width = length - gram, 2 * length - gram
        data, offsets = text_bytes(_flat(docs.column(3)))
        known, hot = _entries(candidates, hash=np.dtype("<u8"), hot=_BYTE)
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        doc, pos, h = _anchors_of(docs, length, gram)
        at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        met = known[at] == h if len(known) else np.zeros(len(h), bool)
        doc, pos, warm = doc[met].astype(np.int64), pos[met].astype(np.int64), hot[at[met]] > 0 if len(known) else np.zeros(0, bool)
        size = np.diff(offsets)
        first, last = np.maximum(pos[warm] - side, 0), np.minimum(pos[warm], size[doc[warm]] - length)
        counts = last - first + 1
        strings = np.unique(np.stack([np.repeat(doc[warm], counts), np.repeat(first, counts) + segments(counts)]), axis=1) if len(counts) else np.zeros((2, 0), np.int64)
        self.whole = np.concatenate([np.zeros(int((~warm).sum()), bool), np.ones(strings.shape[1], bool)])
        self.doc, self.pos = np.concatenate([doc[~warm], strings[0]]), np.concatenate([pos[~warm], strings[1]])
        place = np.empty(docs.num_rows, np.int64)
        place[_ordered(docs)] = np.arange(docs.num_rows)
        self.ord = place[self.doc].astype(_ORD)
        self.ids = np.asarray(docs.column(1))[self.doc]
        self.left = np.where(self.whole, 0, np.minimum(self.pos, side))
        self.right = np.minimum(size[self.doc] - self.pos, length)
        padded = np.concatenate([np.zeros(side, np.uint8), data, np.zeros(length, np.uint8)])
        self.bytes = np.lib.stride_tricks.sliding_window_view(padded, self.width)[offsets[self.doc] + self.pos] if len(self.pos) else np.zeros((0, self.width), np.uint8)
        for short, cut in ((self.left < side, lambda i: np.arange(self.width) < side - self.left[i, None]), (self.right < length, lambda i: np.arange(self.width) >= side + self.right[i, None])):
            i = np.flatnonzero(short)
            self.bytes[i] = np.where(cut(i), 0, self.bytes[i])
        #: The class of equal surroundings of each candidate, and the first candidate of the least doc_id in each.
        self.same, self.first = _classes(self.bytes, _left_key(self.left, self.whole), self.right, self.ids)


def _left_key(left: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Tells whole strings from anchors at the start of a text; left itself is under 127."""
    return np.where(whole, 127, left)


def _classes(data: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class of equal rows; for each class the row of least id).  Equal hashes are verified on the bytes."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _hash_of(data)
    h = (h * np.uint64(128) + left.astype(np.uint64)) * np.uint64(128) + right.astype(np.uint64)
    order = np.lexsort((np.arange(n), ids, h))
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
    of = np.cumsum(new) - 1
    heads = order[new]
    if not all((data[order[i : i + 8192]] == data[heads[of[i : i + 8192]]]).all() for i in range(0, n, 8192)):
        rows = np.concatenate([data, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], axis=1)
        order = np.lexsort((np.arange(n), ids, *rows.T[::-1]))
        new = np.concatenate([[True], (rows[order][1:] != rows[order][:-1]).any(axis=1)])
        of, heads = np.cumsum(new) - 1, order[new]
    same = np.empty(n, np.int64)
    same[order] = of
    return same, heads


def _around(parts: int, length: int, gram: int):
    """Step 3: the surroundings of each class's candidates in its least document, by bucket of the anchor (whole strings by their own)."""

    def each(docs: pa.Table, candidates: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _blobs("bucket", np.zeros(0, np.int64), 0, {n: np.zeros(0, _BYTE) for n in ("ord", "id", "pos", "left", "right", "bytes", "whole")})
        s = _Surroundings(docs, candidates, length, gram)
        sent = np.flatnonzero(s.ids == s.ids[s.first[s.same]]) if len(s.doc) else s.doc
        side, whole = length - gram, s.whole[sent]
        h = _hash_of(s.bytes[sent, side:length])
        h[whole] = _hash_of(s.bytes[sent[whole], side:])
        bucket = (h * _MIX >> np.uint64(40)).astype(np.int64) % parts
        s.bytes = s.bytes[sent]
        columns = {"ord": s.ord[sent], "id": s.ids[sent].astype("<i8"), "pos": s.pos[sent].astype(_POS), "left": s.left[sent].astype(_BYTE), "right": s.right[sent].astype(_BYTE), "bytes": s.bytes, "whole": whole.astype(_BYTE)}
        return _blobs("bucket", bucket, docs.column(0)[0].as_py(), columns)

    return each


def _hash_of(data: np.ndarray) -> np.ndarray:
    values, powers, found = _values(), _powers(_ODD, data.shape[1])[:-1], np.zeros(len(data), np.uint64)
    for i in range(0, len(data), STEP_ROWS):
        found[i : i + STEP_ROWS] = (values[data[i : i + STEP_ROWS]] * powers).sum(axis=1, dtype=np.uint64)
    return found


def _lots(group: np.ndarray, most: int) -> list[slice]:
    """Consecutive rows of about most at most, groups (equal neighbours) whole."""
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group)) if len(group) else np.zeros(0, np.int64)
    found, at = [], 0
    while at < len(group):
        k = np.searchsorted(ends, at + most, side="right") - 1
        to = int(ends[k]) if k >= 0 and ends[k] > at else int(ends[k + 1])
        found.append(slice(at, to))
        at = to
    return found


def _judged(length: int, gram: int):
    """Step 4: verdicts (position of the anchor, first and last byte to remove, from the anchor), by range of documents."""

    def each(table: pa.Table) -> pa.Table:
        ord_, ids, pos, left, right, flat, whole = _entries(table, ord=_ORD, id=np.dtype("<i8"), pos=_POS, left=_BYTE, right=_BYTE, bytes=_BYTE, whole=_BYTE)
        part = _part_of_entries(table, "ord", _ORD)
        side, width = length - gram, 2 * length - gram
        data = flat.reshape(-1, width)
        n = len(data)
        left, right = left.astype(np.int64), right.astype(np.int64)
        first, last = np.full(n, length, np.int64), np.full(n, -length, np.int64)
        strings = np.flatnonzero(whole)
        later = strings[_later_strings(data[strings, side:], ids[strings])]
        first[later], last[later] = 0, length
        around = np.flatnonzero(whole == 0)
        of, heads = _classes(data[around], left[around], right[around], ids[around])
        heads, same = around[heads], np.full(n, -1, np.int64)
        same[around] = of
        # Surroundings that a smaller document has as a whole.
        later = around[(ids[around] > ids[heads[of]]) & (left[around] + right[around] >= length)] if len(around) else around
        first[later], last[later] = -left[later], right[later]
        # Heads of classes, by anchor; those alone with their anchor are done.
        open_ = heads
        h = _hash_of(data[open_, side:length])
        order = np.argsort(h, kind="stable")
        _, group, count = np.unique(h[order], return_inverse=True, return_counts=True)
        several = count[group] > 1
        reps, group = open_[order[several]], group[several]
        if len(reps):
            lo, hi = np.empty(len(reps), np.int64), np.empty(len(reps), np.int64)
            for lot in _lots(group, STEP_ROWS):
                own = reps[lot]
                lo[lot], hi[lot] = _ranges_of_heads(data[own], ids[own], left[own], right[own], group[lot], length, gram)
            # What holds for a class's head holds for all of its document's candidates in the class.
            of_class_lo, of_class_hi = np.full(len(heads), length, np.int64), np.full(len(heads), -length, np.int64)
            of_class_lo[same[reps]], of_class_hi[same[reps]] = lo, hi
            first[around], last[around] = np.minimum(first[around], of_class_lo[of]), np.maximum(last[around], of_class_hi[of])
        hit = np.flatnonzero(first < last)
        return _blobs("part", part[hit], None, {"ord": ord_[hit], "pos": pos[hit], "first": first[hit].astype(_SMALL), "last": last[hit].astype(_SMALL)})

    return each


def _later_strings(data: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rows whose string a smaller id has too: the strings of one hash are sorted, equal ones are neighbours."""
    length = data.shape[1]
    h = _hash_of(data)
    all_by = np.argsort(h, kind="stable")
    found = [np.zeros(0, np.int64)]
    for lot in _lots(h[all_by], STEP_ROWS):
        by = all_by[lot]
        group = np.cumsum(np.concatenate([[True], h[by][1:] != h[by][:-1]])) - 1
        order, extension = suffix_sort(data[by], np.full(len(by), length, np.int64), group)
        head = np.concatenate([[True], (group[1:] != group[:-1]) | (extension[1:] < length)])
        row = by[order]
        least = np.minimum.reduceat(ids[row], np.flatnonzero(head))[np.cumsum(head) - 1]
        found.append(row[ids[row] > least])
    return np.concatenate(found)


def _ranges_of_heads(data: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, group: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte, from the anchor, that strings of smaller documents cover (first > last: none).

    group holds equal hashes of anchors; suffixes that differ within the anchor fall apart in the sort.
    """
    m, side = len(data), length - gram
    by_right, with_right = suffix_sort(data[:, side:], right, group)
    by_left, with_left = suffix_sort(np.ascontiguousarray(data[:, :side][:, ::-1]), left, group)
    start = np.concatenate([[True], group[1:] != group[:-1]])
    lo, hi = np.full(m, length, np.int64), np.full(m, -length, np.int64)
    right_class, left_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for j in range(side + 1):
        has = np.flatnonzero((left >= j) & (right >= length - j))
        if not len(has):
            continue
        right_class[by_right] = np.cumsum(start | (with_right < length - j))
        left_class[by_left] = np.cumsum(start | (with_left < j))
        both = right_class[has] * (m + 1) + left_class[has]
        by = np.argsort(both, kind="stable")
        head = np.concatenate([[True], both[by][1:] != both[by][:-1]])
        least = np.minimum.reduceat(ids[has[by]], np.flatnonzero(head))[np.cumsum(head) - 1]
        hit = has[by[ids[has[by]] > least]]
        lo[hit], hi[hit] = np.minimum(lo[hit], -j), np.maximum(hi[hit], length - j)
    return lo, hi


def _removed(docs: pa.Table, found: pa.Table, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, whether each byte goes) of the documents of a range."""
    verdict = pa.compute.is_valid(found.column("first"))
    s = _Surroundings(docs, found.filter(pa.compute.invert(verdict)), length, gram)
    ord_, pos, first, last = _entries(found.filter(verdict), ord=_ORD, pos=_POS, first=_SMALL, last=_SMALL)
    data, offsets = text_bytes(_flat(docs.column(3)))
    at = offsets[_ordered(docs)[ord_]] + pos
    starts, ends = [at + first], [at + last]
    if len(s.doc):
        later = np.flatnonzero((s.ids > s.ids[s.first[s.same]]) & (s.left + s.right >= length))
        at = offsets[s.doc[later]] + s.pos[later]
        starts.append(at - s.left[later])
        ends.append(at + s.right[later])
    return data, offsets, _covered(len(data), np.concatenate(starts), np.concatenate(ends))


def _covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n bytes lie in any of these intervals, none of them empty."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    apart = starts[1:] > ends[:-1]
    change = np.zeros(n + 1, np.int8)
    if len(starts):  # joined, they neither overlap nor touch
        change[starts[np.append(True, apart)]] = 1
        change[ends[np.append(apart, True)]] = -1
    return np.cumsum(change[:-1], dtype=np.int8).view(bool)


def _left_over(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray, digest: bool) -> list[pa.Array]:
    """n_bytes, n_removed, n_spans and kept of each text."""
    found = [_left_over_at_once(data, offsets[lot.start : lot.stop + 1], gone, digest) for lot in _steps(offsets)]
    return [pa.concat_arrays(x) for x in zip(*found, strict=True)] if found else [pa.array([], k) for k in (*[pa.int64()] * 3, pa.string())]


def _steps(offsets: np.ndarray) -> list[slice]:
    """Texts of about STEP_BYTES together at most, or one longer text."""
    found, at = [], 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, side="right")) - 1)
        found.append(slice(at, to))
        at = to
    return found


def _left_over_at_once(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray, digest: bool) -> list[pa.Array]:
    data, gone, offsets = data[offsets[0] : offsets[-1]], gone[offsets[0] : offsets[-1]], offsets - offsets[0]
    filled = offsets[1:] > offsets[:-1]
    begins, ends = offsets[:-1][filled], offsets[1:][filled] - 1
    first, last = gone.copy(), gone.copy()
    first[1:] &= ~gone[:-1]
    first[begins] = gone[begins]
    last[:-1] &= ~gone[1:]
    last[ends] = gone[ends]
    first, last = np.flatnonzero(first), np.flatnonzero(last) + 1
    runs = np.searchsorted(first, offsets)
    sums = np.concatenate([[0], np.cumsum(last - first)])[runs]
    left = data[~gone].tobytes()
    ends = (offsets - sums).tolist()
    kept = [left[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    kept = [hashlib.sha256(k).hexdigest() for k in kept] if digest else [k.decode("utf-8", "ignore") for k in kept]
    return [pa.array(np.diff(offsets)), pa.array(np.diff(sums)), pa.array(np.diff(runs)), pa.array(kept, pa.string())]


_RESULTS = ("n_bytes", "n_removed", "n_spans", "kept")


def _applied(length: int, gram: int, digest: bool):
    """Step 5: the documents of a range with what is removed from them."""

    def each(docs: pa.Table, found: pa.Table) -> pa.Table:
        own = _left_over(*_removed(docs, found, length, gram), digest)
        return pa.table([_flat(docs.column(1)), *own, *docs.columns[4:]], ["doc_id", *_RESULTS, *docs.column_names[4:]])

    return each


def _spans_of(length: int, gram: int):
    """Step 5 for segments (part, doc_id, rank, text, text_hash, start): the first and last bytes, in the whole text, of what is removed."""

    def each(docs: pa.Table, found: pa.Table) -> pa.Table:
        data, offsets, gone = _removed(docs, found, length, gram)
        starts, ends = [], []
        for k, begin in enumerate(docs.column(5).to_pylist()):
            step = np.diff(np.concatenate([[0], gone[offsets[k] : offsets[k + 1]].astype(np.int8), [0]]))
            starts.append(np.flatnonzero(step == 1) + begin)
            ends.append(np.flatnonzero(step == -1) + begin)
        kind = pa.list_(pa.int64())
        return pa.table([docs.column(1), docs.column(4), pa.array(starts, kind), pa.array(ends, kind)], ["doc_id", "text_hash", "starts", "ends"])

    return each


def _cut_out(digest: bool):
    """Rows (doc_id, text, starts, ends, ...) with what is removed from them, one text at a time."""

    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                data, offsets = text_bytes(row.column(1))
                gone = np.zeros(len(data), bool)
                for a, b in zip(row.column(2)[0].as_py() or (), row.column(3)[0].as_py() or (), strict=True):
                    gone[a:b] = True
                yield pa.RecordBatch.from_arrays([row.column(0), *_left_over(data, offsets, gone, digest), *row.columns[4:]], ["doc_id", *_RESULTS, *row.schema.names[4:]])
            trim()

    return each


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, digest: bool = False, keep: tuple[str, ...] = (), hot: int = HOT, segment: int = SEGMENT_BYTES, crowd: int = CROWD_BYTES) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (the text that is left, or with digest its sha256).

    The columns keep follow as _0, _1, ..., whatever their names.
    """
    if not 0 < gram < length <= 127:
        raise ValueError("0 < gram < length <= 127")
    own = small_batches(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
        *(column(c).alias(f"_{i}") for i, c in enumerate(keep)),
    )
    known = own.where(F.col("doc_id").isNotNull())
    key = ["doc_id", "text_hash"]
    equal = known.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.octet_length("text")).cast("long").alias("size"))
    crowded = (F.col("size") > segment) | ((F.col("n") > 1) & (F.col("n") * F.col("size") > crowd))
    total, n_apart, apart_bytes = equal.agg(F.sum(F.col("n") * F.col("size")), F.count_if(crowded), F.sum(F.when(crowded, F.col("size")))).first()
    parts = max(1, -(-(total or 0) // RANGE_BYTES))
    buckets = LANES * -(-parts // LANES)
    light = known
    if n_apart:
        keys = written(equal.where(crowded).select(*key), "apart")
        keys = F.broadcast(keys) if n_apart <= BROADCAST_ROWS else keys
        light, apart = known.join(keys, key, "left_anti"), known.join(keys, key, "left_semi")
    place = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int").alias("part")
    light = light.select(place, *key, "text", *(f"_{i}" for i in range(len(keep))))
    texts = light.select("part", "doc_id", F.col("text_hash").alias("rank"), "text")
    if n_apart:
        more = max(1, -(-apart_bytes // RANGE_BYTES))
        once = apart.groupBy(*key).agg(F.first("text").alias("text"))
        number = F.greatest(F.ceil((F.octet_length("text") - (length - 1)) / segment), F.lit(1)).cast("int")
        piece = lambda k: F.struct(k.alias("k"), F.substring("text", k * segment + 1, F.lit(segment + length - 1)).alias("text"))
        cut = once.select(*key, F.explode(F.transform(F.sequence(F.lit(0), number - 1), piece)).alias("piece")).select(*key, "piece.*")
        segments_ = cut.select(
            (F.lit(parts) + F.pmod(F.xxhash64(*key, "k"), F.lit(more))).cast("int").alias("part"),
            "doc_id",
            F.xxhash64("text_hash", "k").alias("rank"),
            "text",
            "text_hash",
            (F.col("k").cast("long") * segment).alias("start"),
        )
        segments_ = written(segments_, "segments")
        texts = texts.unionByName(segments_.select("part", "doc_id", "rank", "text"))
    binaries = lambda *names: ", ".join(f"{n} binary" for n in names)

    found = texts.groupBy("part").applyInArrow(_anchors_out(buckets, length, gram), f"bucket int, part int, {binaries('hash', 'times')}")
    candidates = written(found.groupBy("bucket").applyInArrow(_trimmed(_met(hot)), f"part int, {binaries('hash', 'hot')}"), "candidates")
    around = texts.groupBy("part").cogroup(candidates.groupBy("part")).applyInArrow(_trimmed_pair(_around(buckets, length, gram)), f"bucket int, part int, {binaries('ord', 'id', 'pos', 'left', 'right', 'bytes', 'whole')}")
    verdicts = written(around.groupBy("bucket").applyInArrow(_trimmed(_judged(length, gram)), f"part int, {binaries('ord', 'pos', 'first', 'last')}"), "verdicts")
    found = candidates.unionByName(verdicts, allowMissingColumns=True)
    others = light.schema.fields[4:]
    schema = StructType([*StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept string").fields, *others])
    own_found = found.where(F.col("part") < parts) if n_apart else found
    done = light.groupBy("part").cogroup(own_found.groupBy("part")).applyInArrow(_trimmed_pair(_applied(length, gram, digest)), schema)
    if n_apart:
        spans = segments_.groupBy("part").cogroup(found.where(F.col("part") >= parts).groupBy("part")).applyInArrow(_trimmed_pair(_spans_of(length, gram)), "doc_id long, text_hash long, starts array<long>, ends array<long>")
        spans = spans.where(F.size("starts") > 0).groupBy(*key).agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
        rows = apart.join(spans, key, "left").select("doc_id", "text", "starts", "ends", *(f.name for f in others))
        done = done.unionByName(rows.mapInArrow(_cut_out(digest), schema))
    text = F.sha2("text", 256) if digest else F.col("text").cast("string")
    zero = F.lit(0).cast("long")
    unknown = own.where(F.col("doc_id").isNull()).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), text.alias("kept"), *(f.name for f in others))
    return done.unionByName(unknown)


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row."""
    return repeats(docs, length, digest=True).withColumnRenamed("kept", "kept_sha256")


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with what is left of their texts, n_chars (if there) counted anew; documents that lose all of a text go."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = repeats(docs, length, keep=others)
    left = found.where((F.col("n_removed") == 0) | (F.col("kept") != ""))
    columns = {c: F.col(f"_{i}") for i, c in enumerate(others)} | {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return left.select(*(columns[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
