"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate rates and an L1 term (McMahan et al., 2013) leave few weights,
which travel to the executors as two small arrays.  A text's features are the
sets of its hashed words, word stems (first letters, so that inflected forms
share a feature), word pairs and skip pairs (one word left out).  The score is
a function of the whole text alone.

Training takes a bounded sample of the labelled rows: the ``Ftrl.max_rows`` (a
documented parameter) of least hash of (doc_id, text, label) among all of them,
dealt over shards of about ``Ftrl.shard_bytes`` of text.  Each
shard learns by itself, in a fixed number of passes, and the shards' weights are
averaged.  A row's features are a set of hashes, so a task holds at most the
hashes of its shard's words.  A long text is read in pieces that share the words
at their borders, which gives the same set.

Defined results: null and empty texts have no features and get the score of
the bias; null labels and labels without a document are not learnt from; a
doc_id with several labels is learnt from once per label, equal rows with one
label once; without any label of both kinds every score is the prior (0 when
there is none).  Repeated rows are scored each.  Further columns are ignored.  An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from weirflow.llm.common import chunks, column, held_apart, long_pieces, small_batches, text_bytes, written

#: What separates words: all of ASCII but letters and digits.
SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
_FOLD = bytes(32 if c in SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))


#: Text bytes whose words are hashed at once.
PIECE_BYTES = 1 << 20


@dataclass(frozen=True)
class Ftrl:
    bits: int = 20
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 1.0
    epochs: int = 10
    max_rows: int = 12_000
    #: Text bytes of each shard, and shards at least.
    shard_bytes: int = 32 << 20
    shards: int = 1
    stems: tuple[int, ...] = (4, 5)


def _hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _grams(column: pa.Array, model: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """(feature id, its document's row) for each occurrence of a feature."""
    data, offsets = text_bytes(column)
    folded = data.tobytes().translate(_FOLD)
    texts = pa.Array.from_buffers(pa.string(), len(column), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(folded)])
    lists = pc.split_pattern(texts, " ")
    coded = pc.dictionary_encode(lists.values)
    row = np.repeat(np.arange(len(column), dtype=np.int32), np.diff(np.asarray(lists.offsets)))
    code = np.asarray(coded.indices)
    known = coded.dictionary
    filled = np.asarray(pc.greater(pc.binary_length(known), 0))[code]
    code, row = code[filled], row[filled]
    whole = _hashes(known.cast(pa.binary()).to_pylist())
    shift = np.uint64(64 - model.bits)
    of_word = [whole >> shift]
    for n in model.stems:  # a word of no more letters is its own stem
        stems = pc.dictionary_encode(pc.utf8_slice_codeunits(known, 0, n))
        marked = _hashes([w + b"\x00%d" % n for w in stems.dictionary.cast(pa.binary()).to_pylist()])[np.asarray(stems.indices)]
        of_word.append(np.where(np.asarray(pc.utf8_length(known)) > n, marked, whole) >> shift)
    ids, rows = [x.astype(np.int32)[code] for x in of_word], [row] * len(of_word)
    own = whole[code]
    first = own * np.uint64(0x9E3779B97F4A7C15)
    for gap, odd in ((1, 0xBF58476D1CE4E5B9), (2, 0x94D049BB133111EB)):
        pair = ((first[:-gap] + own[gap:]) * np.uint64(odd) >> shift).astype(np.int32)
        same = row[gap:] == row[:-gap]
        ids.append(pair[same])
        rows.append(row[gap:][same])
    return np.concatenate(ids), np.concatenate(rows)


def _pieces(column: pa.Array) -> tuple[pa.Array, np.ndarray | None]:
    """long_pieces whose later pieces begin with the last two words (or more) of the one before."""
    texts, counts = long_pieces(column, PIECE_BYTES)
    if counts is None:
        return texts, None
    own = texts.cast(pa.binary()).to_pylist()
    firsts = set((np.cumsum(counts) - counts).tolist())
    found, tail = [], b""
    for k, piece in enumerate(own):
        whole = piece if k in firsts else tail + piece
        found.append(whole)
        back = 0
        while True:  # far enough back to hold two words, whatever stands between them
            back = min(len(whole), max(4096, 2 * back))
            tail = whole[len(whole) - back :]
            if back == len(whole) or len(tail.translate(_FOLD).split()) > 2:
                break
    return pa.array([w.decode("utf-8", "ignore") for w in found]), counts


def _features(column: pa.Array, model: Ftrl, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of (feature id, row) once, in order of rows; with weights those alone that have one."""
    texts, counts = _pieces(column)
    owner = np.arange(len(column)) if counts is None else np.repeat(np.arange(len(column)), counts)
    found, before = [], 0
    for batch in chunks([pa.RecordBatch.from_arrays([texts], ["text"])], 0, 2 * PIECE_BYTES):
        ids, row = _grams(batch.column(0), model)
        if weights is not None:
            kept = np.flatnonzero(weights[ids])  # most have none
            ids, row = ids[kept], row[kept]
        found.append(_sets(ids, owner[row + before], model.bits))
        before += batch.num_rows
    if len(found) == 1:
        return found[0]
    none = np.zeros(0, np.int64)
    return _sets(np.concatenate([none, *(f[0] for f in found)]), np.concatenate([none, *(f[1] for f in found)]), model.bits)


def _sets(ids: np.ndarray, rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each pair of (feature id, row) once, in order of rows."""
    both = np.unique((rows.astype(np.int64) << bits) | ids)
    return both & ((1 << bits) - 1), both >> bits


def _learn(rows: list[tuple[np.ndarray, int]], model: Ftrl) -> tuple[np.ndarray, float]:
    """Weights and bias after model.epochs passes over (feature ids, label)."""
    z, n = np.zeros(1 << model.bits), np.zeros(1 << model.bits)
    zb = nb = 0.0
    order = np.random.default_rng(7)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= model.l1, 0.0, (np.sign(zi) * model.l1 - zi) / ((model.beta + np.sqrt(ni)) / model.alpha + model.l2))

    for _ in range(model.epochs):
        for k in order.permutation(len(rows)):
            ids, label = rows[k]
            zi, ni = z[ids], n[ids]
            w = weights(zi, ni)
            bias = -zb / ((model.beta + np.sqrt(nb)) / model.alpha)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            z[ids] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / model.alpha * w
            n[ids] = ni + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / model.alpha * bias
            nb += g * g
    return weights(z, n), float(-zb / ((model.beta + np.sqrt(nb)) / model.alpha))


def train(docs: DataFrame, labels: DataFrame, model: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero weights (ids, values) and bias from docs (doc_id, text) and labels (doc_id, toxic).

    What comes to the driver at once is one shard's weights, 2**bits at most.
    """
    own = small_batches(docs).select("doc_id", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"), "text")
    given = labels.where(F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    keys = own.select("doc_id", "hash", "size").join(given, "doc_id").withColumn("draw", F.xxhash64("doc_id", "hash", "toxic"))
    # max_rows of a few numbers each, whatever the input: they may be ordered in one task and broadcast.
    drawn = written(keys.groupBy("draw").agg(F.first("doc_id").alias("doc_id"), F.first("hash").alias("hash"), F.first("toxic").alias("toxic"), F.first("size").alias("size")).orderBy("draw").limit(model.max_rows), "drawn")
    shards = max(model.shards, -(-(drawn.agg(F.sum("size")).first()[0] or 0) // model.shard_bytes))
    rows = own.join(F.broadcast(drawn.drop("size")), ["doc_id", "hash"]).select("text", "toxic", "draw").dropDuplicates(["draw"])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, at = [], []
        for batch in chunks(batches, 0):
            ids, row = _features(batch.column(0), model)
            ids, cuts = ids.astype(np.int32), np.searchsorted(row, np.arange(batch.num_rows + 1))
            labels = batch.column(1).to_pylist()
            rows += [(ids[cuts[i] : cuts[i + 1]], labels[i]) for i in range(batch.num_rows)]
            at += batch.column(2).to_pylist()
        if rows:
            order = sorted(range(len(rows)), key=at.__getitem__)
            weights, bias = _learn([rows[i] for i in order], model)
            ids = np.flatnonzero(weights)
            yield pa.RecordBatch.from_pydict({"n": [len(rows)], "ids": pa.array([ids.astype(np.int32)], pa.list_(pa.int32())), "weights": pa.array([weights[ids]], pa.list_(pa.float64())), "bias": [bias]}, pa.schema([("n", pa.int64()), ("ids", pa.list_(pa.int32())), ("weights", pa.list_(pa.float64())), ("bias", pa.float64())]))

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("draw"), F.lit(shards)).cast("int")).repartitionById(shards, "shard").select("text", "toxic", "draw")
    total, dense, bias = 0, np.zeros(1 << model.bits), 0.0
    found = dealt.mapInArrow(each, "n long, ids array<int>, weights array<double>, bias double")
    for f in written(found, "ftrl").orderBy("n", "bias").toLocalIterator():
        total += f["n"]
        dense[np.array(f["ids"], np.int64)] += np.array(f["weights"]) * f["n"]
        bias += f["bias"] * f["n"]
    dense, bias = dense / max(total, 1), bias / max(total, 1)
    ids = np.flatnonzero(dense)
    return ids, dense[ids], bias if total else -35.0


def score(docs: DataFrame, trained: tuple[np.ndarray, np.ndarray, float], model: Ftrl = Ftrl(), *keep: str, out: str = "score") -> DataFrame:
    """The columns keep (doc_id unless given) of docs with their score, last, by the trained weights."""
    spark = docs.sparkSession
    names = list(keep) or ["doc_id"]
    sent = spark.sparkContext.broadcast((trained[0].astype(np.int32), trained[1].astype(np.float32), trained[2]))
    own = small_batches(docs).select(*(column(c).alias(f"_{i}") for i, c in enumerate(names)))  # any name may come
    inner, schema = [*own.columns, "score"], StructType([*own.schema.fields, StructField("score", DoubleType())])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, bias = sent.value
        dense = np.zeros(1 << model.bits, np.float32)
        dense[ids] = values
        last = len(names)
        for batch in chunks(batches, last, 2 << 20):
            ids, row = _features(batch.column(last), model, dense)
            total = np.bincount(row, dense[ids].astype(np.float64), batch.num_rows) + bias
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], inner)

    rows = docs.select(*(column(c).alias(f"_{i}") for i, c in enumerate(names)), F.col("text").alias("text"))
    return rows.mapInArrow(each, schema).toDF(*names, out)


def train_on(docs: DataFrame, labels: DataFrame, model: Ftrl = Ftrl(), folds: int = 5, held: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """Train on the documents whose crc32(doc_id as text) mod folds is not held."""
    return train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic").where(held_apart("doc_id", folds) != held), model)


def toxicity(docs: DataFrame, labels: DataFrame, model: Ftrl = Ftrl(), folds: int = 5, held: int = 0, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), train_on(docs, labels, model, folds, held), model)
    return scored.select("doc_id", F.coalesce(held_apart("doc_id", folds) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, model: Ftrl = Ftrl(), threshold: float = 0.5) -> DataFrame:
    """docs without those that score threshold or more."""
    mark = "_toxicity"
    while mark in docs.columns:
        mark += "_"
    scored = score(docs, train_on(docs, labels, model), model, *docs.columns, out=mark)
    return scored.where(F.col(mark) < threshold).select(*map(column, docs.columns))
