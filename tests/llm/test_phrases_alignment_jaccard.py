"""Collocations, alignment of tokenizers and similarity groups against plain versions, on awkward rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirflow.llm import alignment, blocks, collocations, jaccard

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["the", "of", "Quiet", "river", "stone", "ça", "été", "lantern", "north-west", "paper"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus():
    """Copies, near copies, a shared passage, nulls, empty and odd texts, a long text, repeated rows, one id twice."""
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ". ", "\n", "\tx"]) for _ in range(n))
    texts = [prose(rng.randrange(1, 90)) for _ in range(60)]
    base = prose(200).split(" ")
    for k in range(25):
        near = list(base)
        for _ in range(k % 4):
            near[rng.randrange(len(near))] = f"edit{rng.randrange(10**6)}"
        texts.append(" ".join(near))
    passage = prose(60)
    texts += [texts[0]] * 6 + [passage + " " + prose(150) for _ in range(8)] + [None, "", "  \n\t ", "one", "one", "Two words", "two words", "a b c d", "a b c d e", "a▁b", "<s> </s> <|endoftext|> <0x41>", "x   y    z", " lead", "trail ", "  ", "a  　  b", "é" * 50, "naïve café №5 日本語 テスト", "tab\t \n end\r\n", prose(4000)]
    langs = ["en", "de", None, ""]
    rows = [(i, t, langs[i % 4] if i % 7 else "und", f"s{i % 3}", None) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[2], None, None, None), (None, None, None, None, None), (7, "another text of one id " + passage, "en", None, 1)]
    random.Random(1).shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with those that the operators use inside."""
    return spark.createDataFrame(rows, DOC).repartition(5).withColumn("block", F.lit(1)).withColumn("c", F.lit("p")).withColumn("number", F.lit(2.0)).withColumn("key", F.lit(0)).withColumn("unit", F.lit("u"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def found(df):
    return Counter(tuple(r) for r in df.collect())


# -- collocations -------------------------------------------------------------------------------------------------


def plain_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        held = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        gone = {g[i : i + 2] for g, a in held.items() if len(g) == 3 for i in (0, 1) if 100 * a >= 50 * counts[g[i : i + 2]]}
        scored = []
        for g, a in held.items():
            if len(g) == 3 or g not in gone:
                score, k = min((1_000_000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top])]
    return Counter(out)


@pytest.mark.parametrize("least,top,block", [(10, 2000, 1 << 24), (2, 7, 3000), (3, 2000, 500)])
def test_collocations(docs, rows, least, top, block):
    got = found(collocations.collocations(docs, least, top, block_bytes=block, range_rows=300))
    assert got == plain_collocations(rows, least, top)
    assert len(got) > 8


def test_collocations_of_nothing(empty, spark):
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, "en"), (2, "", None), (3, " .,; ", "x")], "doc_id long, text string, lang string")).count() == 0


def test_long_texts_are_split_in_pieces(spark, monkeypatch):
    """Stretches and pieces far smaller than the texts give the same phrases; workers are forked, so pieces are cut here."""
    rng = random.Random(2)
    text = " ".join(rng.choice(["a", "b,", "Cc", "d\n", "e"]) for _ in range(3000))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([text, "x y", text])], ["text"])
    streams = []
    for most in (1 << 22, 97):
        known, own = blocks.Numbers(), []
        for data, offsets, _, last in blocks.pieces(batch, 0, most):
            own.append(collocations._stream(data, offsets, last, known))
        streams.append((np.concatenate(own).tolist(), list(known.known)))
    assert streams[0] == streams[1]
    ids = np.array(streams[0][0]) + 1
    want = Counter(t for t in zip(ids.tolist(), ids[1:].tolist(), strict=False) if 0 not in t)
    monkeypatch.setattr(collocations, "STRETCH", 50)
    got = Counter()
    for hi, lo, times in collocations._counted(ids, None):
        for a, b, t in zip(*collocations.unpacked(hi, lo)[:2], times, strict=True):
            got[(int(a), int(b))] += int(t)
    assert got == want


def test_radix_order():
    rng = np.random.default_rng(4)
    lo, hi = rng.integers(0, 2**63, 500, dtype=np.uint64), rng.integers(0, 3, 500).astype(np.uint64)
    assert collocations.radix_order([lo, hi]).tolist() == np.lexsort((lo, hi)).tolist()
    a, b, c = (rng.integers(0, 2**42, 100) for _ in range(3))
    for x, y in zip(collocations.unpacked(*collocations._packed(a, b, c)), (a, b, c), strict=True):
        assert (x == y).all()


# -- alignment ----------------------------------------------------------------------------------------------------


def plain_alignment(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    a_model, b_model = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_model.encode_special_tokens = True
    a_bytes, b_bytes = alignment.token_bytes(a_path, b_path)
    made = []
    for doc_id, text, *_ in rows:
        a = b = []
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)
            if not b"".join(a_bytes[i] for i in a) == b"".join(b_bytes[i] for i in b) == (" " + text).encode():
                a = b = []
        spans = []
        for ids, spelled in ((a, a_bytes), (b, b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(spelled[i]), i))
                at += len(spelled[i])
            spans.append(own)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, lo = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for s, _, i in own if lo <= s < c) for own in spans))
            lo = c
        links, j = [], 0
        for s, e, i in spans[0]:
            links += [(i, k) for x, y, k in spans[1] if x < e and s < y] if len(spans[1]) < 3000 else []
        made.append((doc_id, a, b, groups, links))
    counts = Counter(p for m in made for p in set(m[4]))
    most = Counter()
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    return Counter((d, len(a), len(b), len(g), len(k), sum(counts[p] == most[p[0]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for d, a, b, g, k in made)


@pytest.mark.parametrize("block", [1 << 25, 2000])
def test_alignment(docs, rows, block):
    short = [r for r in rows if len(r[1] or "") < 5000]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = found(alignment.alignment(docs.where("length(text) < 5000 OR text IS NULL"), block_bytes=block).select(*names))
    want = plain_alignment(short)
    assert not (got - want) and not (want - got)
    assert sum(n for r, n in want.items() if r[1] == 0) == 4  # nulls, empty, and a text with the mark that stands for a space


def test_alignment_of_nothing(empty):
    assert alignment.alignment(empty).count() == 0


def test_units_and_whole_texts_align_alike(spark, rows, monkeypatch):
    """What the operator does for tokenizers that may look across spaces: a unit is a whole text."""
    short = spark.createDataFrame([r for r in rows if len(r[1] or "") < 400], DOC)
    units = found(alignment.alignment(short))
    monkeypatch.setattr(alignment, "separable", lambda a, b: False)
    assert found(alignment.alignment(short)) == units


def test_ends_of_both_sides_make_links_and_groups(spark):
    rows = [(1, 1, 3, [1, 1, 2, 7, 8], [1, 2, 5, 2, 5]), (1, 2, 1, [5, 6, 6, 6], [4, 1, 3, 4]), (2, 1, 4, [9, 9, 4, 3, 8, 1], [2, 3, 4, 6, 1, 6]), (3, 1, 1, [0, 0], [1, 1])]
    tokens = spark.createDataFrame(rows, "h1 long, h2 long, n_a int, ids array<int>, ends array<int>")
    got = {(r.h1, r.h2): [(x >> 32, (x & 0xFFFFFFFF) >> 2, x & 3) for x in r.links] for r in alignment.aligned(tokens).collect()}
    assert got == {(1, 1): [(1, 7, 1), (1, 7, 3), (2, 8, 3)], (1, 2): [(5, 6, 2), (5, 6, 2), (5, 6, 3)], (2, 1): [(9, 8, 2), (9, 1, 1), (9, 1, 1), (4, 1, 1), (3, 1, 3)], (3, 1): [(0, 0, 3)]}
    links = [got[k] for k in sorted(got)]
    flat = np.array([(a << 32) + (b << 2) + kind for own in links for a, b, kind in own])
    assert alignment._spelled(flat, np.array([len(own) for own in links])) == ["1,1|7;2|8", "5|6,6,6", "9,9,4,3|8,1", "0|0"]


def test_tokens_are_shuffled_as_their_units_only(spark):
    """No exchange holds a row for each token or end: none has more rows than there are units and documents (of two letters there are few id pairs)."""
    sc = spark.sparkContext
    words = ["".join(random.Random(k).choices("qz", k=24)) for k in range(4000)]
    docs = spark.createDataFrame([(i, " ".join(words[i::4])) for i in range(4)], "doc_id long, text string").coalesce(1)

    def stages():
        jvm = sc._jvm
        none = jvm.java.util.ArrayList()
        found = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(jvm.double, 0), none)
        return {s.stageId(): s.shuffleWriteRecords() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    assert alignment.alignment(docs).count() == 4
    made = [n for k, n in stages().items() if k not in before]
    assert 4000 <= max(made) < 8000


def test_long_texts_have_the_same_units():
    import pyarrow as pa

    rng = random.Random(6)
    text = "".join(rng.choice(["a", "é", " ", "  ", "\n", "word ", "日", "\t "]) for _ in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array(["x y", text, None, "", "z" * 700, text])], ["text"])
    found = []
    for most in (1 << 22, 200):
        known = blocks.Numbers()
        parts = list(alignment.document_units(batch, 0, known, True, most))
        units = list(known.known)
        found.append((sum((r.tolist() for r, _, _ in parts), []), [[units[i] for i in c] for _, own, _ in parts for c in own]))
        assert sum(n for _, _, n in parts) == sum(len((t or "").encode()) for t in batch.column(0).to_pylist())
    assert found[0] == found[1]
    assert ["".join(c) for c in found[0][1]] == [" " + t if t else "" for t in batch.column(0).to_pylist()]


# -- similarity groups --------------------------------------------------------------------------------------------


def plain_groups(rows, size=5, percent=80):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], len(sets[i]), least.get(find(i))) for i, r in enumerate(rows))


@pytest.mark.parametrize("size,percent", [(5, 80), (2, 60), (1, 100)])
def test_near_sets(docs, rows, size, percent):
    got = found(jaccard.near_sets(docs, size, percent))
    assert got == plain_groups(rows, size, percent)


def test_near_sets_by_chance(spark):
    """Small alphabets: sets of all likenesses around the limit, many of them meeting on common tokens."""
    rng = random.Random(12)
    rows = []
    for i in range(300):
        base = random.Random(i % 12)
        w = [base.choice("abcdefgh") for _ in range(30)]
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = rng.choice("abcdefgh")
        rows.append((i, " ".join(w), None, None, None))
    got = found(jaccard.near_sets(spark.createDataFrame(rows, DOC)))
    assert got == plain_groups(rows)
    assert 12 <= len({r[2] for r in got}) < 290


def test_near_sets_of_nothing(empty):
    assert jaccard.near_sets(empty).count() == 0


def test_long_texts_have_the_same_tokens():
    import pyarrow as pa

    rng = random.Random(9)
    text = " ".join(rng.choice(WORDS) for _ in range(3000))
    batch = pa.RecordBatch.from_arrays([pa.array(["x y", text, None, "", text + " end"])], ["text"])
    whole = [(r.tolist(), t.tolist(), n.tolist()) for r, t, n in jaccard.token_sets(batch, 0)]
    original = blocks.pieces
    try:
        jaccard.pieces = lambda b, c: original(b, c, 500)
        cut = [(r.tolist(), t.tolist(), n.tolist()) for r, t, n in jaccard.token_sets(batch, 0)]
    finally:
        jaccard.pieces = original
    join = lambda parts: [sum((p[k] for p in parts), []) for k in range(3)]
    assert join(whole) == join(cut) and len(cut) > 2


@pytest.mark.parametrize("parts,blocks", [(32, 1), (8, 4), (1, 40), (50, 2)])
def test_lots_of_blocks_are_of_a_size(spark, parts, blocks):
    rows = spark.createDataFrame([((p << 32) + b,) for p in range(parts) for b in range(blocks)], "block long").select(alignment._lot().alias("lot")).collect()
    sizes = [sum(r.lot == k for r in rows) for k in range(alignment.LOTS)]
    assert max(sizes) - min(sizes) <= max(blocks % alignment.LOTS, 1)
