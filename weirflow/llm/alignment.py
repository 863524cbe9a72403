"""Where the tokens of two tokenizers end together, and which of them overlap.

Both tokenizers here end a token before each space that follows a visible
character: so a text is a row of units, a space and what follows, and its alignment is
that of its units one after the other.  Units repeat, so the relational steps run
over the corpus's distinct units, each tokenized once: tokens are exploded with their
positions and ends, those of both sides meet by unit and end, where both have one a group
ends, and a running window finds the two tokens that cover what lies before each end, which are
a link.  Documents, as numbers of a block's units, meet the results block by block.

Where a tokenizer might look across such a space (``separable``), the units are whole
texts, and the same steps hold.

Defined results: null and empty texts and those whose tokens do not spell a space and
the text have no tokens and zeros; null doc_ids and repeated rows are documents
each; an id pair is counted once for each document row that holds it; equal
counts of an A id are all its best; further columns are ignored; an empty table gives an
empty result.  A long text's units are numbered in pieces of 4 MB; a worker holds 4
bytes for each unit of a text, and a block's distinct units with their links.
"""

from __future__ import annotations

import hashlib
import json
import sys
import types
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.blocks import LAST, PIECE_BYTES, Numbers, meeting, met, numbers, pieces
from weirflow.llm.common import drop_shared, small_batches, text_bytes, written

#: UTF-8 bytes of text of a block: larger ones repeat fewer units.
BLOCK_BYTES = 32 << 20
#: Lots of blocks that meet their units' results one after the other, so that one lot's shuffle is on disk at a time.
LOTS = 4
#: Units that are tokenized as one text.
TOGETHER = 256
#: Rows of an Arrow batch that a worker sends.
SEND = 1 << 14


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def separable(a_path: str, b_path: str) -> bool:
    """Whether no token of either holds a space after another character, and nothing else looks across one."""
    with open(a_path, encoding="utf-8") as f:
        known = json.load(f)
    split = known.get("pre_tokenizer") or {}
    a = known.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
    b = _b(b_path)
    odd = "ﬁ ①  é\n x "
    plain = b.normalize(odd) == "▁" + odd.replace(" ", "▁")
    return bool(a and plain and not any("▁" in b.id_to_piece(i).lstrip("▁") for i in range(b.vocab_size())))


def _kept(key: str) -> types.ModuleType:
    """A place that outlives a task in its Python worker."""
    return sys.modules.setdefault(f"weirflow-known:{key}", types.ModuleType("known"))


def _a(path: str):
    kept = _kept(f"a:{path}")
    if not hasattr(kept, "library"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        kept.library = Tokenizer.from_file(path)
        kept.library.encode_special_tokens = True
    return kept.library


def _b(path: str):
    kept = _kept(f"b:{path}")
    if not hasattr(kept, "library"):
        import sentencepiece

        kept.library = sentencepiece.SentencePieceProcessor(model_file=path)
    return kept.library


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: visible Latin-1 characters for themselves, the other bytes from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def token_bytes(a_path: str, b_path: str) -> tuple[list[bytes], list[bytes]]:
    """The bytes of each id of the two vocabularies."""
    letters = byte_letters()
    entries = _a(a_path).get_vocab(with_added_tokens=False)
    a = [b""] * (max(entries.values(), default=-1) + 1)
    for word, i in entries.items():
        a[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
    b_model = _b(b_path)
    b = []
    for i in range(b_model.vocab_size()):
        piece = b_model.id_to_piece(i)
        b.append(bytes([int(piece[3:5], 16)]) if b_model.is_byte(i) else piece.replace("▁", " ").encode())
    return a, b


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Where units begin: spaces after a visible ASCII character or a two-byte letter."""
    before = np.concatenate([[32], data[:-1]])
    lead = np.concatenate([[0, 0], data[:-2]])[: len(data)]
    safe = (before > 32) & (before < 127) | (before >= 128) & (lead >= 0xC3) & (lead <= 0xDF)
    return np.flatnonzero((data == 32) & safe)


def document_units(batch: pa.RecordBatch, column: int, known: Numbers, cut: bool, most: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, list[np.ndarray], int]]:
    """(rows, their units as numbers of known, bytes read) of the batch's texts, each with a space before it; without cut a text is one unit."""
    carried: np.ndarray | None = None
    unfinished: list[np.ndarray] = []
    read = 0
    for data, offsets, row, last in pieces(batch, column, most):
        read += len(data)
        new = offsets[:-1] < offsets[1:]
        if carried is not None:
            new[0] = False
        insert = offsets[:-1][new]
        data, offsets = np.insert(data, insert, np.uint8(32)), offsets + np.searchsorted(insert, offsets, side="left")
        if carried is not None:
            data, offsets = np.concatenate([carried, data]), np.concatenate([[0], offsets[1:] + len(carried)])
            carried = None
        begins = np.zeros(len(data), bool)
        begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        if cut:
            begins[unit_starts(data)] = True
        at = np.flatnonzero(begins)
        if not last[-1]:  # its last unit may go on
            to = int(at[-1])
            carried, data, offsets, at = data[to:], data[:to], np.append(offsets[:-1], to), at[:-1]
        edges = np.append(at, len(data)).astype(np.int32)
        codes = known(pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])).astype("<i4")
        place = np.searchsorted(at, offsets)
        own = [codes[a:b] for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]
        if unfinished:
            own[0] = np.concatenate([*unfinished, own[0]])
            unfinished = []
        if not last[-1]:
            unfinished = [own.pop()]
        if own:
            yield row[: len(own)], own, read
            read = 0


_UNITS = "block long, kind int, row long, doc_id long, codes binary, units array<string>"


def _coded(docs: DataFrame, block_bytes: int, cut: bool) -> DataFrame:
    """Documents as numbers (int32, compressed) of their block's units, and for each block its distinct units."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        known, size, row_id = Numbers(), 0, 0
        empty = pa.array([None], pa.list_(pa.string()))

        def units() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([0], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([list(known.known)], pa.list_(pa.string()))], names)

        for batch in batches:
            for row, own, read in document_units(batch, 1, known, cut):
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.full(n, LAST, np.int32)), pa.array(np.arange(row_id, row_id + n)), batch.column(0).take(pa.array(row)), pa.array([zlib.compress(c.tobytes(), 1) for c in own], pa.binary()), pa.nulls(n, empty.type)], names)
                row_id += n
                size += read
            if size >= block_bytes:
                yield units()
                block, known, size = block + 1, Numbers(), 0
        if row_id:
            yield units()

    names = [c.split()[0] for c in _UNITS.split(", ")]
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(rows.mapInArrow(each, _UNITS).withColumn("lot", _lot()), "units", "zstd", ["kind", "lot"])


def _lot() -> Column:
    """The lot of a block: those of a partition, and the first ones of all partitions, are dealt round, so that lots are of a size."""
    return F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1)), F.lit(LOTS)).cast("int")


def _ends_safely(units: pa.Array) -> np.ndarray:
    """Units after which another one, which begins with a space, is a unit of its own (as in unit_starts)."""
    data, offsets = text_bytes(units)
    ends = offsets[1:]
    last, lead = data[ends - 1], data[np.maximum(ends - 2, 0)]
    return (last > 32) & (last < 127) | (last >= 128) & (ends - offsets[:-1] > 2) & (lead >= 0xC3) & (lead <= 0xDF)


class _Speller:
    """One tokenizer over many units: (ids, sizes in bytes, tokens of each unit, whether they spell it)."""

    def __init__(self, encode, spelled: list[bytes]):
        self.encode, self.spelled = encode, spelled
        self.sizes = np.fromiter(map(len, spelled), np.int32, len(spelled))

    def together(self, units: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Units side by side as one text, None unless its tokens spell it and end where each unit does."""
        text = "".join(units)
        ids = np.array(self.encode(text), np.int32)
        upto = np.cumsum(self.sizes[ids], dtype=np.int64)
        place = np.minimum(np.searchsorted(upto, ends), max(len(upto) - 1, 0))
        if not len(ids) or not (upto[place] == ends).all() or b"".join(map(self.spelled.__getitem__, ids.tolist())) != text.encode():
            return None
        return ids, np.diff(np.append(0, place + 1)), np.ones(len(units), bool)

    def alone(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = [self.encode(u) for u in units]
        fits = [b"".join(map(self.spelled.__getitem__, x)) == u.encode() for x, u in zip(ids, units, strict=True)]
        return np.fromiter((i for x in ids for i in x), np.int32), np.fromiter(map(len, ids), np.int64, len(ids)), np.array(fits, bool)

    def __call__(self, units: list[str], sizes: np.ndarray, n_together: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        found = []
        for k in range(0, n_together, TOGETHER):
            own = units[k : min(k + TOGETHER, n_together)]
            found.append(self.together(own, np.cumsum(sizes[k : k + len(own)])) or self.alone(own))
        found.append(self.alone(units[n_together:]))
        ids, counts, fits = (np.concatenate([f[k] for f in found]) for k in range(3))
        return ids, self.sizes[ids], counts, fits


def _tokenized(units: DataFrame, a_path: str, b_path: str, cut: bool) -> DataFrame:
    """(h1, h2, fits, n_a, ids, ends): each unit's n_a tokens of A, then those of B, and where in the unit they end; fits where both sides spell it."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _kept(f"spellers:{a_path}:{b_path}")
        if not hasattr(kept, "spellers"):
            a, b = _a(a_path), _b(b_path)
            space = [b.piece_to_id("▁")]
            a_bytes, b_bytes = token_bytes(a_path, b_path)
            kept.spellers = _Speller(lambda u: a.encode(u, add_special_tokens=False).ids, a_bytes), _Speller(lambda u: space if u == " " else b.encode(u[1:]), b_bytes)
        for batch in batches:
            if not batch.num_rows:
                continue
            safe = _ends_safely(batch.column(2)) if cut else np.zeros(batch.num_rows, bool)
            batch = batch.take(pa.array(np.argsort(~safe, kind="stable")))
            units, sizes = batch.column(2).to_pylist(), np.asarray(pc.binary_length(batch.column(2))).astype(np.int64)
            sides = of_a, of_b = [speller(units, sizes, int(safe.sum())) for speller in kept.spellers]
            # B's tokens go after A's, unit by unit.
            order = np.argsort(np.concatenate([np.repeat(np.arange(len(units)), side[2]) for side in sides]), kind="stable")
            offsets = pa.array(np.concatenate([[0], np.cumsum(of_a[2] + of_b[2])]).astype(np.int32))
            ids, ends = (pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(both)[order].astype(np.int32))) for both in ([side[0] for side in sides], [_ends(side) for side in sides]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(of_a[3] & of_b[3]), pa.array(of_a[2].astype(np.int32)), ids, ends], ["h1", "h2", "fits", "n_a", "ids", "ends"])

    return units.select("h1", "h2", "unit").mapInArrow(each, "h1 long, h2 long, fits boolean, n_a int, ids array<int>, ends array<int>")


def _ends(side: tuple[np.ndarray, ...]) -> np.ndarray:
    """Where in its unit each token ends."""
    _, sizes, counts, _ = side
    upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return upto[1:] - np.repeat(upto[np.cumsum(counts) - counts], counts)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What names a unit: 128 bits of hashes.
UNIT = ("h1", "h2")
#: Rows that stand in the order of their group are aggregated in one step as they come.
_IN_ORDER = "spark.sql.execution.replaceHashWithSortAgg"


def aligned(tokenized: DataFrame) -> DataFrame:
    """(h1, h2, links) of tokens (h1, h2, n_a, ids, ends); h1 and h2 name a unit, ids are below 2**30.

    The relational steps: tokens are dealt by unit once, stay there and are put in order once.
    The two sides' tokens meet by unit and end.  From a unit's last end to its first one, what lies
    before an end, down to the next one, is covered by the token of each side that came last: so
    each end is one link, a * 2**32 + b * 4 + (1 if A's token ends here) + (2 if B's does); 3 ends a group.
    """
    ranges = int(tokenized.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    token = F.posexplode(F.arrays_zip("ids", "ends")).alias("pos", "t")
    own = tokenized.repartition(ranges, *UNIT).select(*UNIT, "n_a", token).select(*UNIT, F.col("t.ends").alias("end"), F.col("t.ids").alias("id"), (F.col("pos") < F.col("n_a")).alias("of_a"))
    ends = own.groupBy(*UNIT, "end").agg(F.max(F.when(F.col("of_a"), F.col("id"))).alias("a"), F.max(F.when(~F.col("of_a"), F.col("id"))).alias("b"))
    down = Window.partitionBy(*UNIT).orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    over = lambda c: F.last(c, ignorenulls=True).over(down).cast("long")
    here = lambda c, bit: F.when(F.col(c).isNotNull(), F.lit(bit)).otherwise(0)
    link = F.shiftleft(over("a"), 32) + over("b") * 4 + here("a", 1) + here("b", 2)
    whole = ends.select(*UNIT, "end", link.alias("link")).groupBy(*UNIT).agg(F.collect_list("end").alias("ends"), F.collect_list("link").alias("links"))
    return whole.select(*UNIT, F.sort_array(F.arrays_zip("ends", "links"))["links"].alias("links"))


def _written_in_order(df: DataFrame, tag: str, by: list[str]) -> DataFrame:
    """df written, aggregates of rows in order in one step."""
    conf = df.sparkSession.conf
    before = conf.get(_IN_ORDER)
    conf.set(_IN_ORDER, "true")
    try:
        return written(df, tag, "zstd", by)
    finally:
        conf.set(_IN_ORDER, before)


def _spelled(links: np.ndarray, per_unit: np.ndarray) -> list[str]:
    """Groups as `a1,a2|b1;a3|b2,b3` of units with so many links each, in order."""
    kind = links & 3
    ends = np.flatnonzero(kind == 3)

    def side(ids: np.ndarray, here: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(here)[ends]]).astype(np.int32)
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[here]).cast(pa.string())), ",")

    groups = pc.binary_join_element_wise(side(links >> 32, kind & 1 > 0), side((links & 0xFFFFFFFF) >> 2, kind & 2 > 0), "|")
    of_units = np.searchsorted(ends, np.concatenate([[0], np.cumsum(per_unit)])).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(of_units), groups), ";").to_pylist()


class _Block:
    """What a block's units hold: v are their links (see aligned), none where the unit does not fit.

    Links become places among the block's distinct pairs, at once for each batch, so that the rows can go.
    Units are counted and their groups spelled where asked for.
    """

    def __init__(self, parts: list[pa.RecordBatch] | None, spell: bool = False):
        local = numbers(parts, 2)
        n = int(local.max(initial=-1)) + 1
        self.fits, self.counts = np.zeros(n, bool), np.zeros((3, n), np.int32)
        self.n_links, self.link_start = np.zeros(n, np.int32), np.zeros(n, np.int64)
        self.groups: list[str | None] = [None] * n
        self.pairs = np.zeros(0, np.int64)
        spans: list[tuple[np.ndarray, np.ndarray]] = []
        total = 0
        while parts:
            part = parts.pop(0)
            at, lists = part.column(2).to_numpy(), part.column(8)
            flat, sizes = lists.flatten().to_numpy(), np.diff(np.asarray(lists.offsets).astype(np.int64))
            at, sizes = at[sizes > 0], sizes[sizes > 0]
            starts = np.cumsum(sizes) - sizes
            self.fits[at], self.n_links[at], self.link_start[at] = True, sizes, total + starts
            total += len(flat)
            if spell and len(flat):
                kind = flat & 3
                for k, here in enumerate((kind & 1, kind >> 1, kind == 3)):
                    self.counts[k, at] = np.add.reduceat(here, starts, dtype=np.int32)
                for k, s in zip(at.tolist(), _spelled(flat, sizes), strict=True):
                    self.groups[k] = s
            found, inverse = np.unique(flat & ~3, return_inverse=True)
            spans.append((found, inverse.astype(np.int32)))
        self.pairs = np.unique(np.concatenate([self.pairs, *(f for f, _ in spans)]))
        self.places = np.concatenate([np.zeros(0, np.int32), *(np.searchsorted(self.pairs, f).astype(np.int32)[i] for f, i in spans)])

    def links_of(self, units: np.ndarray) -> np.ndarray:
        """The places of all links of these units."""
        sizes = self.n_links[units].astype(np.int64)
        return self.places[np.repeat(self.link_start[units] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]

    def sums(self, worth: np.ndarray) -> np.ndarray:
        """For each unit the sum over its links of their pairs' worth."""
        running = np.concatenate([[0], np.cumsum(worth[self.places])])
        return running[self.link_start + self.n_links] - running[self.link_start]


def _distinct(values: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The distinct ones of small numbers, in any order; mark has room for each of them and any content."""
    places = np.arange(len(values), dtype=np.int32)
    mark[values] = places
    return values[mark[values] == places]


def _codes(rows: pa.RecordBatch) -> Iterator[np.ndarray]:
    for c in rows.column(5).to_pylist():
        yield np.frombuffer(zlib.decompress(c), "<i4")


_FOUND = "block long, pair long, n long, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _by_lots(one, tag: str, used: Iterable[str] = ()) -> DataFrame:
    """The union of one(lot), each written before the next one; narrow rows go to Python in larger batches meanwhile.

    Of the folders used, a lot's part goes as soon as the lot is written.
    """
    found = None
    for lot in range(LOTS):
        df = one(lot)
        conf = df.sparkSession.conf
        before = conf.get(_BATCH)
        conf.set(_BATCH, str(SEND))  # rows of codes stay few by their bytes
        try:
            part = written(df, tag, "zstd")
        finally:
            conf.set(_BATCH, before)
        found = part if found is None else found.unionAll(part)
        for folder in used:
            drop_shared(df.sparkSession, f"{folder}/lot={lot}")
    return found


def _first_pass(coded: DataFrame, entries: DataFrame) -> DataFrame:
    """Two kinds of rows: (block, pair, n), how many of a block's documents hold an id pair linked; (block, row, doc_id, n_a ... groups_sha256) of each document."""
    schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split() for c in _FOUND.split(", "))])

    def rows_of(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[pa.RecordBatch]:
            held = np.flatnonzero(times)
            for k in range(0, len(held), SEND):
                s = held[k : k + SEND]
                yield rows_of(block=np.full(len(s), at), pair=own.pairs[s], n=times[s])

        at, own, mark = None, _Block(None), None
        times = np.zeros(0, np.int64)
        for block, parts, rows in met(batches):
            if parts is not None:
                yield from done()
                at, own = block, None  # the block before goes first
                own = _Block(parts.pop(0, None), True)
                times, mark = np.zeros(len(own.pairs), np.int64), (np.zeros(len(own.fits), np.int32), np.zeros(len(own.pairs), np.int32))
            out: list[list] = [[], [], [], [], []]
            for codes in _codes(rows):
                if len(codes) and own.fits[codes].all():
                    times[_distinct(own.links_of(_distinct(codes, mark[0])), mark[1])] += 1
                    sha = hashlib.sha256(";".join(map(own.groups.__getitem__, codes.tolist())).encode()).hexdigest()
                    found = [*(int(own.counts[k][codes].sum()) for k in range(3)), int(own.n_links[codes].sum()), sha]
                else:
                    found = [0, 0, 0, 0, ""]
                for o, f in zip(out, found, strict=True):
                    o.append(f)
            yield rows_of(block=np.full(rows.num_rows, at), row=rows.column(6), doc_id=rows.column(7), **dict(zip(("n_a", "n_b", "n_groups", "n_links", "groups_sha256"), out, strict=True)))
        yield from done()

    def one(lot: int) -> DataFrame:
        documents, own = coded.where((F.col("kind") == LAST) & (F.col("lot") == lot)), entries.where(F.col("lot") == lot)
        return meeting(documents, own.select("block", F.lit(0).alias("kind"), "a", "v")).mapInArrow(each, _FOUND)

    return _by_lots(one, "found")


def _second_pass(coded: DataFrame, entries: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, row, n_best, count_sum) of each document, from the counts (block, a: pair, b: count * 2 + best)."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for block, parts, rows in met(batches):
            if parts is not None:
                own = best = total = None  # the block before goes first
                sums = parts.pop(1, None)
                pairs, value = numbers(sums, 2), numbers(sums, 3)
                order = np.argsort(pairs)
                pairs, value = pairs[order], value[order]
                own = _Block(parts.pop(0, None))
                held = np.minimum(np.searchsorted(pairs, own.pairs), max(len(pairs) - 1, 0))
                worth = np.where(pairs[held] == own.pairs, value[held], 0) if len(pairs) else np.zeros(len(own.pairs), np.int64)
                best, total = own.sums(worth & 1), own.sums(worth >> 1)
            sums_of = [(int(best[c].sum()), int(total[c].sum())) if own.fits[c].all() else (0, 0) for c in _codes(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, block)), rows.column(6), *(pa.array([x[k] for x in sums_of], pa.int64()) for k in (0, 1))], ["block", "row", "n_best", "count_sum"])

    def one(lot: int) -> DataFrame:
        documents, own = coded.where((F.col("kind") == LAST) & (F.col("lot") == lot)).drop("doc_id"), entries.where(F.col("lot") == lot)
        sums = counts.where(_lot() == lot)
        return meeting(documents, own.select("block", F.lit(0).alias("kind"), "a", "v"), sums.select("block", F.lit(1).alias("kind"), "a", "b")).mapInArrow(each, "block long, row long, n_best long, count_sum long")

    return _by_lots(one, "ends", (entries._written, f"{coded._written}/kind={LAST}"))  # nothing reads them after this


def alignment(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of docs (doc_id, text)."""
    a_path, b_path = a_path or _vocabulary("byte_bpe_50k.json"), b_path or _vocabulary("piece_bpe_32k.model")
    cut = separable(a_path, b_path)
    coded = _coded(docs, block_bytes, cut)
    own = coded.where("kind = 0").select("block", "lot", F.posexplode("units").alias("a", "unit"))
    hashes = {"h1": F.xxhash64("unit"), "h2": F.xxhash64(F.lit(1), "unit")}
    tokens = _tokenized(own.select("unit").distinct().withColumns(hashes), a_path, b_path, cut)
    facts = aligned(tokens.where("fits").drop("fits"))
    named = own.withColumns(hashes).select("block", "a", *UNIT).join(facts, [*UNIT], "left").select("block", _lot().alias("lot"), "a", F.coalesce("links", F.array().cast("array<long>")).alias("v"))
    entries = _written_in_order(named, "entries", ["lot"])
    drop_shared(docs.sparkSession, f"{coded._written}/kind=0")  # the units' strings have done their work

    found = _first_pass(coded, entries)
    here = found.where("pair IS NOT NULL").select("block", "pair", "n")
    counts = here.groupBy("pair").agg(F.sum("n").alias("count"))
    most = counts.groupBy(F.shiftright("pair", 32).alias("id")).agg(F.max("count").alias("most"))
    worth = written(counts.join(most, F.shiftright("pair", 32) == F.col("id")).select("pair", (F.col("count") * 2 + (F.col("count") == F.col("most")).cast("long")).alias("b")), "worth")
    sums = written(here.select("block", "pair").join(worth, "pair").select("block", F.col("pair").alias("a"), "b"), "sums")
    ends = _second_pass(coded, entries, sums)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return found.where("row IS NOT NULL").drop("pair", "n").join(ends, ["block", "row"]).select(*names)
