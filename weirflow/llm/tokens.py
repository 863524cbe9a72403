"""Token ids: encoding, ORC files of token ids, and what reads them back.

Layout of a token table: one ORC row per document (key columns, ids), range
parts in ascending key order.  ORC stores the ids by integer run-length
encoding in stripes with row indexes, and a Bloom filter on doc_id, so that
readers take stripes in parallel and skip those that cannot hold an id.

The library encodes each distinct white-space-separated chunk once per worker.
This equals encoding the whole text where the vocabulary's normaliser and
pre-tokeniser never look across ASCII white space; ``Encoder`` knows the ones
(``CUTS``) of which that holds, with any other it encodes whole texts.  A long
text is encoded in pieces that end before white space, so a worker holds its ids
(4 bytes each) and a few times ``ENCODE_BYTES``, not a multiple of the text.
"""

from __future__ import annotations

import json
import struct
import sys
import types
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import chunks, long_pieces, shared_path, small_batches, text_bytes

#: ASCII white space becomes one kind of separator.
_SPACE = bytes(32 if c in b" \t\n\r\x0b\x0c" else c for c in range(256))
#: 1 letters, 2 punctuation but the apostrophe, of ASCII.
_KIND = np.array([1 if chr(c).isalpha() else 2 if 32 < c < 127 and not chr(c).isalnum() and c != 39 else 0 for c in range(128)] + [0] * 128, np.uint8)
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c for c in _SPACE)
#: Distinct chunks whose ids a worker keeps in a generation.
CACHE = 300_000
#: Text bytes that are encoded at once: more share more chunks.
ENCODE_BYTES = 4 << 20
#: Text bytes for each file of a token table.
FILE_BYTES = 64 << 20
#: Bytes of a stripe's buffers; a file of FILE_BYTES of text has several stripes, each of which a reader can take by itself.
STRIPE_BYTES = 4 << 20
#: Rows of a stripe's row groups, and between checks of its size.
GROUP_ROWS = 1000
# The normaliser and the pre-tokeniser that fold A-Z, take all white space for one kind and cut there, and cut between a letter and punctuation.
CUTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes columns of texts to one flat array of ids and the texts' lengths in ids.

    What it knows of chunks outlives a task: the next tasks of the same Python
    worker use it too.  It is kept in two generations; the older one goes when
    the younger is full.
    """

    def __init__(self, path: str, end_id: int | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kept = sys.modules.setdefault(f"weirflow-known:{path}", types.ModuleType("known"))
        if not hasattr(self.kept, "library"):
            self.kept.library, self.kept.young, self.kept.old = Tokenizer.from_file(path), {}, {}
            vocabulary = self.kept.library.get_vocab(with_added_tokens=False)
            self.kept.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
            self.kept.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
            known = json.loads(self.kept.library.to_str())
            marks = {t["content"] for t in known.get("added_tokens", ())}
            self.kept.cuts = all(known.get(k) == v for k, v in CUTS.items()) and known["model"].get("end_of_word_suffix") == "</w>" and all(m.startswith("<|") for m in marks)
        self.library, self.end_id = self.kept.library, end_id

    def _new(self, chunk: list[str]) -> list[bytes]:
        """The ids of each chunk, from the library: words of letters together, all else one by one."""
        found: list[bytes] = [b""] * len(chunk)
        words = [i for i, c in enumerate(chunk) if c.isalpha()]
        others = [i for i, c in enumerate(chunk) if not c.isalpha()]
        for k in range(0, len(words), 4096):
            own = words[k : k + 4096]
            ids = np.array(self.library.encode_batch_fast([" ".join([chunk[i] for i in own])], add_special_tokens=False)[0].ids, np.int32)
            ends = np.flatnonzero(self.kept.ends[ids]) + 1 if ids.size and ids.max() < len(self.kept.ends) else ()
            if len(ends) == len(own) and ends[-1] == len(ids):  # each word is one pre-token, which ends with its one word end
                data, cuts = ids.tobytes(), [0, *(ends * 4).tolist()]
                for n, i in enumerate(own):
                    found[i] = data[cuts[n] : cuts[n + 1]]
            else:
                others += own
        for i, e in zip(others, self.library.encode_batch_fast([chunk[i] for i in others], add_special_tokens=False), strict=True):
            found[i] = struct.pack(f"<{len(ids := e.ids)}i", *ids)
        return found

    def _ids(self, chunk: list[str]) -> tuple[np.ndarray, np.ndarray]:
        young, old = self.kept.young, self.kept.old
        found = list(map(young.get, chunk))
        missed = [i for i, f in enumerate(found) if f is None]
        new = []
        for i in missed:
            if (f := old.get(chunk[i])) is None:
                new.append(i)
            else:
                found[i] = f
        for i, f in zip(new, self._new([chunk[i] for i in new]), strict=True):
            found[i] = f
        if len(young) + len(missed) > CACHE:
            self.kept.young, self.kept.old = {}, young
        self.kept.young |= ((chunk[i], found[i]) for i in missed)
        return np.frombuffer(b"".join(found), np.int32), np.fromiter(map(len, found), np.int32, len(found)) // 4

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, ids of each row)."""
        if not self.kept.cuts:
            found = self.library.encode_batch_fast(["" if t is None else t for t in column.to_pylist()], add_special_tokens=False)
            lengths = np.fromiter((len(e.ids) for e in found), np.int64, len(found))
            return self._ended(np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in found)]), lengths)
        texts, counts = long_pieces(column, ENCODE_BYTES)
        if counts is None:
            return self._ended(*self._cut(texts))
        parts = [self._cut(b.column(0)) for b in chunks([pa.RecordBatch.from_arrays([texts], ["text"])], 0, ENCODE_BYTES)]
        lengths = np.concatenate([p[1] for p in parts])
        return self._ended(np.concatenate([p[0] for p in parts]), np.add.reduceat(lengths, np.cumsum(counts) - counts))

    def _ended(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.end_id is None:
            return ids, lengths
        out = np.full(len(ids) + len(lengths), self.end_id, np.int32)
        rest = np.ones(len(out), bool)
        rest[np.cumsum(lengths + 1) - 1] = False
        out[rest] = ids
        return out, lengths + 1

    def _cut(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(column)
        data, offsets = _apart(data, offsets)
        texts = pa.Array.from_buffers(pa.string(), len(column), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
        lists = pc.split_pattern(texts, " ")
        edges = np.asarray(lists.offsets)
        coded = pc.dictionary_encode(lists.values)
        del lists, texts, data
        flat, sizes = self._ids(coded.dictionary.to_pylist())
        code = np.asarray(coded.indices)
        each = sizes[code]
        before = np.concatenate([np.zeros(1, np.int32), np.cumsum(each, dtype=np.int32)])
        lengths = np.diff(before[edges]).astype(np.int64)
        at = np.arange(before[-1], dtype=np.int32)
        at += np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[code] - before[:-1], each)
        return flat[at], lengths


def _apart(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that encode alike in fewer distinct chunks.

    White space becomes spaces and A-Z lower case (the normaliser does both), and
    a space goes between an ASCII letter and ASCII punctuation after it (but
    apostrophes, which may start a pre-token), where the pre-tokeniser cuts
    anyway.  Where special tokens may stand only white space changes.
    """
    raw = data.tobytes()
    if len(data) < 2 or b"<|" in raw:
        return np.frombuffer(raw.translate(_SPACE), np.uint8), offsets
    data = np.frombuffer(raw.translate(_FOLDED), np.uint8)
    kind = _KIND[data]
    at = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
    return np.insert(data, at, np.uint8(32)), offsets + np.searchsorted(at, offsets, side="left")


def lists_of(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(ids, pa.int32()))


def list_parts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, offsets from 0) of a column of id lists."""
    offsets = np.asarray(column.offsets).astype(np.int64)
    return np.asarray(column.values)[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts_for(docs: DataFrame, file_bytes: int = FILE_BYTES) -> int:
    """Range parts for a table of this much text: by its bytes, at least the session's shuffle partitions."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // file_bytes))


def write_tokens(ordered: DataFrame, path: str, end_id: int, tokenizer: str | None = None, stripe_bytes: int = STRIPE_BYTES) -> DataFrame:
    """Encodes ordered (doc_id, text; each partition a sorted range) to an ORC token table; returns it as read back.

    Its columns: doc_id, part (the range's number), local (ids before the
    document in its part), n (its ids, the end id included) and ids.
    """
    tokenizer = tokenizer or vocabulary()
    schema = "doc_id long, part int, local long, n long, ids array<int>"

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, total = Encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        for batch in chunks(batches, 1, ENCODE_BYTES):
            ids, lengths = encoder(batch.column(1))
            before = total + np.cumsum(lengths) - lengths
            total += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(lengths), part, np.int32)), pa.array(before), pa.array(lengths), lists_of(ids, lengths)], ["doc_id", "part", "local", "n", "ids"])

    rows = ordered.select("doc_id", "text").mapInArrow(each, schema)
    layout = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01, "orc.row.index.stride": GROUP_ROWS, "orc.stripe.size": stripe_bytes, "orc.rows.between.memory.checks": GROUP_ROWS, "compression": "zstd"}
    rows.write.options(**layout).orc(path)
    return ordered.sparkSession.read.schema(schema).orc(path)


def bases(table: DataFrame) -> dict[int, int]:
    """Ids before each part of a token table.  One number for each of its files comes to the driver: 16 bytes for FILE_BYTES of text (25 MB at 100 TB)."""
    totals = table.groupBy("part").agg(F.max(F.col("local") + F.col("n")).alias("all")).orderBy("part").collect()
    found, total = {}, 0
    for row in totals:
        found[row["part"]] = total
        total += row["all"]
    return found


def token_table(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None, path: str | None = None, stripe_bytes: int = STRIPE_BYTES) -> DataFrame:
    """Writes docs (doc_id, text) as a token table in ascending doc_id order and returns it as read back.

    Null text is empty and so has the end id alone; a null doc_id comes first;
    documents of one id stay side by side, in the order of their text's hash;
    repeated rows are documents each; further columns are left out; an empty
    table gives an empty one.
    """
    path = path or shared_path(docs.sparkSession, "tokens")
    own = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), "tie"]
    return write_tokens(own.repartitionByRange(parts_for(own), *order).sortWithinPartitions(*order), path, end_id, tokenizer, stripe_bytes)


def digest(table: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document of a token table."""
    sent = table.sparkSession.sparkContext.broadcast(bases(table))

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = sent.value
        for batch in batches:
            ids, offsets = list_parts(batch.column(3))
            start = np.asarray(batch.column(2)) + np.array([base[p] for p in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(start), pa.array(np.diff(offsets)), pa.array(crcs(ids, offsets[:-1], offsets[1:]), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return table.select("doc_id", "part", "local", "ids").mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def crcs(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """crc32 of the little-endian 32-bit ids of each span."""
    data = memoryview(ids.astype("<u4").tobytes())
    return [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
