"""Each operator of llm against a plain version, on small tables of awkward rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from weirflow.llm import chat, common, decontam, license, lm, packing, quality, simhash, substrings, tokens, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = ["the", "of", "and", "river", "stone", "quiet", "morning", "Über", "wanders", "seven", "lantern", "ça", "gold", "paper", "under", "north", "because", "ship"]


def prose(rng, n):
    return " ".join(rng.choice(PROSE) + rng.choice(["", "", ".", ",", "er", "ing"]) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, null and empty texts, ties, a long text, null ids."""
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(40)]
    shared = prose(rng, 40)
    texts += [texts[0]] * 3 + [texts[1] + " end", shared, "Start. " + shared, shared + "\n" + prose(rng, 10), None, "", "   \n\t", "one", "one two", prose(rng, 6000), "a" * 300, "b" + "a" * 250, "é" * 80, "x" + "é" * 80]
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[2], None, None, None), (None, None, None, None, None), (7, "another text of the same id " + shared, None, None, 1)]
    random.Random(4).shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names clash with those that operators use inside."""
    return spark.createDataFrame(rows, DOC).repartition(5).withColumn("key", F.lit(1)).withColumn("part", F.lit("p")).withColumn("_row", F.lit(2.0)).withColumn("k1", F.lit(0))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# -- common -------------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(1, 200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = common.connected(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == want
    assert common.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chunks():
    batch = pa.RecordBatch.from_arrays([pa.array(["ab", None, "", "c" * 50, "de"])], ["t"])
    got = list(common.chunks([batch, batch.slice(0, 0)], 0, 4))
    assert [b.num_rows for b in got] == [3, 1, 1]
    data, offsets = common.text_bytes(batch.slice(1, 3).column(0))
    assert data.tobytes() == b"c" * 50 and offsets.tolist() == [0, 0, 0, 50]


# -- 1 quality ----------------------------------------------------------------------------------------------------


def test_quality(spark, docs, rows, empty):
    extra = [(900, "a b c d a b c d x\nx\nx\n \n", None, None, 0), (901, "###$ " * 60, None, None, 0), (902, " ".join(f"w{i} |" for i in range(60)), None, None, 0), (903, "\n".join(["Accept all cookies now"] * 30), None, None, 0)]
    table = docs.select(*[c for c in docs.columns if c in DOC]).unionByName(spark.createDataFrame(extra, DOC))
    got = quality.clean(table).collect()
    assert len(got) == len(rows) + len(extra)
    for r in got:
        w, lines = words(r.text), [x for x in (r.text or "").split("\n") if words(x)]
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.kept and r.base_failed)
    by = {r.doc_id: r for r in got}
    assert not by[901].kept and not by[902].kept and not by[903].kept and by[903].cleaned == ""
    furniture = re.compile("|".join(quality.BOILERPLATE), re.IGNORECASE)

    def passes(line):
        w, bars = words(line), line.count("|")
        if sum(c in "#*$%&|<>" for c in line) > 0.1 * len(line) or (bars >= 3 and 6 * bars >= len(w)):
            return False
        return not (len(w) >= 6 and 2 * line.count("!") >= len(w)) and not (len(w) >= 8 and len(set(w)) < 0.3 * len(w)) and not furniture.search(line)

    for r in got:
        lines = [x for x in (r.text or "").split("\n") if passes(x)]
        assert r.cleaned == "\n".join(lines)
        part = sum(len(x) for line in lines for x in words(line)) / r.word_chars if r.word_chars else 0.0
        assert r.left == pytest.approx(part) and r.kept == (not r.base_failed and part >= 0.7)
    plain = [r for r in got if r.doc_id is not None and r.doc_id < 40 and not r.base_failed]
    assert plain and all(r.kept and r.cleaned == r.text for r in plain)
    assert quality.clean(empty).count() == 0


# -- 2 simhash ----------------------------------------------------------------------------------------------------


def test_simhash(docs, rows, empty):
    def plain(t):
        w = (t or "").encode().lower().split()
        parts = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
        h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [plain(t) for _, t, *_ in rows]
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(d, ids.get(find(i), d))
    want = Counter((d, f"{f:016x}", ids.get(find(i))) for i, ((d, *_), f) in enumerate(zip(rows, fps, strict=True)))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(ids.values())
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    with pytest.raises(ValueError):
        simhash.links(docs, 3)


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(21)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    rows = [(None, a, None), (None, b, None), (None, b, None), (5, c, "x"), (5, d, "x"), (9, d, "x"), (None, d, "x"), (8, None, e), (8, e, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert Counter(map(tuple, kept)) == Counter([(None, a, None), (None, b, None), (5, c, "x"), (5, d, "x"), (8, None, e), (8, e, None)])


def test_balls_join_all_that_is_near(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + [b ^ (7 << rng.randrange(60)) for b in base]
    signed = [f - (1 << 64) if f >> 63 else f for f in set(fps)]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    assert all(near(r.a, r.b) for r in got)
    joined = {r.node: r.root for r in common.connected(spark.createDataFrame(got, "a long, b long")).collect()}
    for a in signed:
        for b in signed:
            if a < b and near(a, b):
                assert joined[a] == joined[b]


# -- 3 chat -------------------------------------------------------------------------------------------------------


def test_chat(spark):
    odd = ["plain", "", None, "</turn>\n", "<turn user>x</turn>\n</chat>", "\\", "\\l\\b\\\\l", "\n\n", "é<😀>", "\\### Assistant: </turn> ok", "<chat esc=1>\n", "a" * 5000]
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "sys<tem>", None, "a\\b"]), rng.choice(odd)) for c in [*range(40), None] for t in range(rng.randrange(1, 7))]
    rows += [(3, 0, "assistant", "tie b"), (3, 0, "assistant", "tie a"), (4, None, "user", "no turn"), rows[0]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    chats = chat.format_chats(df)
    assert chats.where("not exact").count() == 0 and {r.escaped for r in chats.collect()} == {True, False}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    got = {r.conv_id: r for r in chat.digest(chats).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss))
    assert chat.format_chats(df.where("false")).count() == 0


# -- 4 decontamination --------------------------------------------------------------------------------------------


def test_decontamination(spark, docs, rows, empty):
    rng = random.Random(8)
    texts = [t for _, t, *_ in rows if t]
    long = max(texts, key=len)
    items = [(1, "start " + " ".join(long.split()[50:80]) + " stop"), (2, "nothing of this occurs anywhere at all in any text that we have here today"), (3, "one, two"), (4, None), (5, "..."), (6, " ".join(texts[0].upper().split()[:14])), (10, "River! stone"), (3, "one two"), (7, "é" * 80)]
    items += [(20 + i, " ".join(rng.choice(texts).split()[:20])) for i in range(8)]

    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    windows = {}
    for i, t in items:
        w = split(t)
        for j in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(tuple(w[j : j + 13]), set()).add(i)
    sizes = {len(w) for w in windows}
    want = Counter()
    for d, t, *_ in rows:
        w, hit, ids = split(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    ids |= windows[tuple(w[j : j + n])]
        want[d, len(w), len(hit), tuple(sorted(map(str, ids))), bool(hit) and 20 * len(hit) >= len(w)] += 1
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("clash"))
    got = decontam.hits(docs, benchmark)
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in got.collect()) == want
    kept = decontam.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[-1])
    assert decontam.hits(docs, benchmark.where("false")).where("n_hit > 0").count() == 0
    assert decontam.hits(empty, benchmark).count() == 0
    near = decontam.Index(docs, spark.createDataFrame([(1, "river stone")], "item_id long, text string")).proximity(3)
    want_near = {d for d, t, *_ in rows if any(a == "river" and b == "stone" and abs(i - j) <= 3 for i, a in enumerate(split(t)) for j, b in enumerate(split(t)))}
    assert {r.doc_id for r in near.collect()} == want_near


def test_words_do_not_depend_on_what_follows(spark):
    rest = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "ΟΔΟΣ'" + rest), (2, rest), (3, rest)], "doc_id long, text string")
    item = spark.createDataFrame([(7, "ΟΔΟΣ " + rest)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids) for r in decontam.hits(docs, item).collect()}
    assert got == {1: (13, 13, ["7"]), 2: (12, 0, []), 3: (12, 0, [])}


# -- 5 and 8 tokens -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoded(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary())
    return [e.ids for e in library.encode_batch([t or "" for _, t, *_ in rows], add_special_tokens=False)]


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.vocabulary())
    odd = ["", "  ", "á b c d", "x<|endoftext|>y", "It's DON'T ́q \x1c\x1d\x85 z", "İstanbul ΣΑΣ ΟΔΟΣ. Å", "<|STARTOFTEXT|>. B", "a≠b", "क़ qa", "we'll!! e... f,. .g", "1.5% a-b", "\x0b\x0c\r\n"]
    for texts in ([o] for o in odd):
        ids, lengths = tokens.Encoder(tokens.vocabulary(), None)(pa.array(texts))
        assert ids.tolist() == library.encode(texts[0], add_special_tokens=False).ids and lengths.tolist() == [len(ids)]
    ids, lengths = tokens.Encoder(tokens.vocabulary(), 9)(pa.array(odd))
    assert ids.tolist() == [i for e in library.encode_batch(odd, add_special_tokens=False) for i in [*e.ids, 9]]


def test_token_table(spark, docs, rows, encoded, empty, tmp_path):
    table = tokens.token_table(docs, path=f"file://{tmp_path}/t")
    got = sorted(tokens.digest(table).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, *_ in rows), key=lambda d: -1 if d is None else d)
    total = 0
    for r in got:
        assert r.start == total
        total += r.n_tokens
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(e) + 1, crc([*e, 2])) for (d, *_), e in zip(rows, encoded, strict=True))
    plan = table.where("doc_id = 5").select("n")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,5)]" in plan and "ids" not in plan.split("ReadSchema")[-1]
    assert tokens.digest(tokens.token_table(empty)).count() == 0


def scanned(df):
    """Rows that the scan of a query gives to the query, after stripes and row groups are passed over."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_stripes_row_groups_and_bloom_filters(spark, tmp_path):
    import glob

    from pyarrow import orc

    docs = spark.range(0, 24_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("a few words of text number "), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        table = tokens.token_table(docs, path=f"file://{tmp_path}/t", stripe_bytes=1 << 16)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    (file,) = glob.glob(f"{tmp_path}/t/*.orc")
    stripes = orc.ORCFile(file).nstripes
    assert stripes > 2 and orc.ORCFile(file).nrows == 12_000
    # Stripes are read by tasks of their own.
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(os.path.getsize(file) // stripes))
    try:
        sizes = [n for n in spark.read.orc(f"file://{tmp_path}/t").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(sizes) > 2 and sum(sizes) == 12_000
    # Least and largest doc_id of a row group leave one group of 1000 rows; the Bloom filter leaves none for an id between two others.
    assert table.where("doc_id = 5000").count() == 1
    assert 0 < scanned(table.where("doc_id = 5000").select("doc_id", "n")) <= tokens.GROUP_ROWS
    absent = [scanned(table.where(f"doc_id = {i}").select("doc_id", "n")) for i in range(5001, 5041, 2)]
    assert sum(n == 0 for n in absent) >= 15


def test_other_tokenizers_are_encoded_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"[UNK]": 0, "Ab": 1, "ab": 2, "Ab cd": 3}, unk_token="[UNK]"))
    other.pre_tokenizer = pre_tokenizers.Split("|", "removed")
    other.save(f"{tmp_path}/other.json")
    ids, lengths = tokens.Encoder(f"{tmp_path}/other.json", 7)(pa.array(["Ab|ab|Ab cd", None, "x|Ab"]))
    assert ids.tolist() == [1, 2, 3, 7, 7, 0, 1, 7] and lengths.tolist() == [4, 1, 3]


def test_long_texts_are_encoded_in_pieces(monkeypatch):
    rng = random.Random(61)
    texts = pa.array([prose(rng, 300), "", None, "x" * 500 + " " + prose(rng, 200), prose(rng, 10), "y" * 400])
    whole = tokens.Encoder(tokens.vocabulary(), 2)(texts)
    table = packing.projection()
    keys = packing.curve_keys(texts, table)
    monkeypatch.setattr(tokens, "ENCODE_BYTES", 64)
    monkeypatch.setattr(packing, "VECTOR_BYTES", 64)
    pieces = tokens.Encoder(tokens.vocabulary(), 2)(texts)
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces, strict=True))
    assert len(common.long_pieces(texts, 64)[0]) > 20
    near = packing.curve_keys(texts, table)
    assert (np.abs(near - keys) <= np.abs(keys) * 1e-3 + 1e9).all()


def test_packing(docs, rows, encoded, empty):
    pieces = packing.packed(docs, length=64)
    got = pieces.collect()
    assert Counter(r.sequence_id for r in got).keys() == set(range(max(r.sequence_id for r in got) + 1))
    filled = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled[r.sequence_id] and r.length == len(r.ids) > 0
        filled[r.sequence_id] += r.length
    assert max(filled.values()) == 64 and sum(v < 64 for v in filled.values()) <= 1
    whole = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        if r.start == 0:
            whole.setdefault(r.doc_id, []).append([])
    assert sum(r.start == 0 for r in got) == len(rows)
    assert Counter(i for r in got for i in r.ids) == Counter(i for e in encoded for i in [*e, 1])
    by = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        by.setdefault(r.doc_id, []).append(r)
    for d, e in zip((d for d, *_ in rows), encoded, strict=True):
        if sum(x == d for x, *_ in rows) == 1:
            assert [i for r in by[d] for i in r.ids] == [*e, 1] and all(r.doc_tokens == len(e) + 1 for r in by[d])
    crc = {(r.doc_id, r.sequence_id, r.offset): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    assert {(r.doc_id, r.sequence_id, r.offset): r.ids_crc32 for r in packing.packed(docs, length=64, digest=True).collect()} == crc
    assert packing.packed(empty).count() == 0


def test_hilbert_neighbours_touch():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = packing.hilbert(points, 3)
    assert sorted(keys.tolist()) == list(range(side**3))
    steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_curve_keys_bring_like_texts_together():
    rng = random.Random(9)
    texts = [prose(rng, 80) for _ in range(50)]
    table = packing.projection()
    both = packing.curve_keys(pa.array([*texts, *texts, "", None, " "]), table)
    assert (both[:50] == both[50:100]).all() and len(set(both[100:])) == 1
    assert (packing.curve_keys(pa.array(["b a", "a\nb", "ab"]), table)[:2] == packing.curve_keys(pa.array(["a b"] * 2), table)).all()


# -- 6 language model ---------------------------------------------------------------------------------------------


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def tokens_of(t):
    return [*(t or "").encode().lower().split(), b"\n"]


def test_language_model(spark, docs, rows, empty):
    got = lm.scores(docs).collect()
    toks = [(d, tokens_of(t)) for d, t, *_ in rows]
    count = Counter(w for d, ws in toks if not held(d) for w in ws)
    n, v = sum(count.values()), len(count)
    want = Counter((d, held(d), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 5)) for d, ws in toks)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lm.scores(empty).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(60) if held(i)], "doc_id long, text string")
    assert {r.train_tokens for r in lm.scores(only_held).collect()} == {0}


def plain_scores(rows, model):
    """The model with dicts and loops over tokens, one range: (doc_id, text, score) of each row, and the probabilities' sums over each class."""
    h = lambda w: xxhash.xxh64_intdigest(w)
    mask = (1 << 64) - 1
    odds, start = [int(x) for x in lm._ODDS], int(lm._START)
    key = {r[:2]: i for i, r in enumerate(rows)}
    toks = [tokens_of(t) for _, t in rows]
    trains = [not held(d) for d, _ in rows]
    count = Counter(w for ws, tr in zip(toks, trains, strict=True) if tr for w in ws)
    vocabulary = sorted({w for ws in toks for w in ws})
    frequent = sorted(count, key=lambda w: (-count[w], h(w)))[: model.own]
    suffix = lambda w: model.own + xxhash.xxh32_intdigest(w[-model.suffix :]) % (64 - model.own)
    of = {w: frequent.index(w) if w in frequent else suffix(w) for w in vocabulary}
    ones, twos = sum(c == 1 for c in count.values()), sum(c == 2 for c in count.values())
    d = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.95)
    size, types = Counter(), Counter()
    for w, c in count.items():
        size[of[w]] += c
        types[of[w]] += 1
    cut = lambda c: 0.0 if c < len(frequent) else d
    unseen = lambda c: 1.0 if not size[c] else 1e-12 if c < len(frequent) else max(d * types[c], 1e-3) / size[c]
    share = lambda w: max(count[w] - cut(of[w]), 1e-3) / size[of[w]] if count[w] else unseen(of[w])
    cell = lambda b: (b * odds[1] & mask) >> (64 - model.cell_bits)
    contexts = []  # (document, token, hashes one, two and three back)
    for i, ws in enumerate(toks):
        hs = [start] * 3 + [h(w) for w in ws]
        contexts += [(i, w, hs[j + 2 :: -1][:3]) for j, w in enumerate(ws)]
    pairs = Counter((cell(b[0]), w) for i, w, b in contexts if trains[i])
    after = Counter(cell(b[0]) for i, w, b in contexts if trains[i])
    n = sum(count.values())

    def kind(p, c, k):
        if p <= 0:
            return 0
        return min(max(math.floor(math.log2(p / (max(after[k], 1) * max(c, 1) / n)) / 2) + model.excess // 3, 0), model.excess - 1) + 1

    mass, of_tokens, seen = Counter(), Counter(), Counter()
    for (k, w), p in pairs.items():
        mass[of[w], k, kind(p, count[w], k)] += share(w)
    for i, w, b in contexts:
        k = cell(b[0])
        if trains[i] and count[w] > 1:
            seen[kind(pairs[k, w] - 1, count[w] - 1, k)] += 1
            of_tokens[of[w], k] += 1
    places = sorted({m[:2] for m in mass} | set(of_tokens) | {(of[w], cell(b[0])) for i, w, b in contexts})
    table = np.array([[mass[*m, z] for m in places] for z in range(1, model.excess + 1)])
    table = np.concatenate([np.maximum(1 - table.sum(axis=0), 1e-9)[None], table])
    theta, fill, goal = np.zeros(model.excess + 1), np.array([of_tokens[m] for m in places]), np.array([seen[z] for z in range(model.excess + 1)])
    for _ in range(model.rounds):
        weighed = np.exp(theta)[:, None] * table
        expected = (weighed * (fill / weighed.sum(axis=0))).sum(axis=1)
        theta += np.clip(np.log((goal + 0.5) / (expected + 0.5)), -2, 2)
        theta = np.clip(theta - theta[0], -20, 20)
    z = dict(zip(places, (np.exp(theta)[:, None] * table).sum(axis=0), strict=True))

    weights, rates = [{}, {}], [{}, {}]
    bias, bias_rate = [np.zeros(8), np.zeros(8)], [1e-6, 1e-6]

    def rows_of(b, group=None):
        mixed = [((x * odds[k] & mask) ^ (x >> 29)) * odds[4] & mask for k, x in enumerate(b)] + [(b[0] * odds[3] + b[1]) * odds[4] & mask]
        at = [m >> (64 - model.bits) for m in mixed]
        return at if group is None else [a ^ (((group + 1) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - model.bits)) for a in at]

    def chances(t, at):
        x = sum((weights[t].get(a, 0) for a in at), bias[t].copy())
        e = np.exp(x - x.max())
        return e / e.sum()

    order = sorted(range(len(rows)), key=lambda i: (len((rows[i][1] or "").encode()), keys_of[i]))
    by = {}
    for c in contexts:
        by.setdefault(c[0], []).append(c)
    stream = [c for i in order if trains[i] for c in by[i]]
    for s in range(0, len(stream), model.batch):
        for t in (0, 1):
            total, total_bias = {}, np.zeros(8)
            for i, w, b in stream[s : s + model.batch]:
                group, label = divmod(of[w], 8)
                at = rows_of(b, group if t else None)
                g = chances(t, at)
                g[label if t else group] -= 1
                total_bias += g
                for a in at:
                    total[a] = total.get(a, 0) + g
            for a, g in total.items():
                rates[t][a] = rates[t].get(a, 0) + g @ g
                weights[t][a] = weights[t].get(a, 0) - g * model.rate / math.sqrt(rates[t][a] + 1e-6)
            bias_rate[t] += total_bias @ total_bias
            bias[t] -= total_bias * model.rate / math.sqrt(bias_rate[t])
    out = [0.0] * len(rows)
    for i, w, b in contexts:
        k = cell(b[0])
        group, label = divmod(of[w], 8)
        p = chances(0, rows_of(b))[group] * chances(1, rows_of(b, group))[label]
        out[i] += math.log10(p * share(w) * math.exp(theta[kind(pairs[k, w], count[w], k)]) / z[of[w], k])
    # All tokens of a class and its unseen share, after any cell, sum to 1.
    for c, k in places[:: max(len(places) // 200, 1)]:
        if size[c]:
            total = sum(share(w) * math.exp(theta[kind(pairs[k, w], count[w], k)]) / z[c, k] for w in count if of[w] == c) + (0 if c < len(frequent) else unseen(c) / z[c, k])
            assert total == pytest.approx(1, abs=1e-6)
    return out


keys_of = []


def test_language_model_equals_a_plain_one(spark):
    rng = random.Random(41)
    rows = [(i, prose(rng, rng.randrange(1, 60))) for i in range(120)] + [(500, ""), (501, None), (502, "A  b\nA b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.MaxEnt(bits=12, batch=256)
    keys = {r.doc_id: r.key for r in df.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"), "text").collect()}
    keys |= {r.doc_id: r.key for r in df.where("text is null").select("doc_id", F.xxhash64("doc_id", "text").alias("key")).collect()}
    keys_of[:] = [keys[d] for d, _ in rows]
    want = plain_scores(rows, model)
    got = {r.doc_id: r.score for r in lm.scores(df.repartition(3), model).collect()}
    for (d, _), w in zip(rows, want, strict=True):
        assert got[d] == pytest.approx(w, rel=2e-3, abs=2e-3)
    # The layout of the table does not matter.
    again = {r.doc_id: r.score for r in lm.scores(df.repartition(7), model).collect()}
    assert all(again[d] == pytest.approx(got[d], rel=1e-9) for d in got)


def test_language_model_of_crowds_and_long_texts(spark, monkeypatch):
    """Equal rows worked on once, texts read in pieces and many ranges give the counts of plain reading."""
    rng = random.Random(42)
    rows = [(i, prose(rng, rng.randrange(1, 300))) for i in range(30)]
    rows += [(None, "same text here")] * 50 + [(7, "and the same id")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, lm.scores(df).collect()), key=repr)
    assert len(whole) == len(rows)
    monkeypatch.setattr(lm, "PIECE_BYTES", 200)
    pieces = sorted(map(tuple, lm.scores(df, crowd=100).collect()), key=repr)
    assert [r[:5] for r in pieces] == [r[:5] for r in whole] and all(a[5] == pytest.approx(b[5], rel=1e-9) for a, b in zip(pieces, whole, strict=True))
    many = sorted(map(tuple, lm.scores(df, lm.MaxEnt(range_bytes=2000)).collect()), key=repr)
    assert [r[:5] for r in many] == [r[:5] for r in whole]


def test_short_counts():
    counts = np.array([0, 1, 2, 255, 256, 1000, 123456, 10**12])
    back = lm.long(lm.short(counts) | lm._OWNER)
    assert back[:5].tolist() == counts[:5].tolist() and (np.abs(back - counts) <= counts / 128).all()


def test_pieces_of_a_text_keep_its_context(monkeypatch):
    rng = random.Random(43)
    texts = pa.array([prose(rng, 200), None, "x", prose(rng, 3), prose(rng, 500)])
    whole = list(lm.blocks(texts))
    monkeypatch.setattr(lm, "PIECE_BYTES", 50)
    cut = list(lm.blocks(texts, 60))
    assert len(whole) == 1 and len(cut) > 20
    assert np.array_equal(np.concatenate([b.h for b in cut]), whole[0].h)
    for k in range(lm.BACK):
        assert np.array_equal(np.concatenate([b.back()[k] for b in cut]), whole[0].back()[k])


# -- 7 licences ---------------------------------------------------------------------------------------------------


def plain_words(text):
    """Letters and digits by hand: runs of letters, of digits (dots between digits stay), mixed runs cut where the kinds meet a digit first."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        j = i
        if c in "0123456789":
            while j < len(text) and text[j] in "0123456789":
                j += 1
            while j + 1 < len(text) and text[j] == "." and text[j + 1] in "0123456789":
                j += 1
                while j < len(text) and text[j] in "0123456789":
                    j += 1
        elif c.isalpha():
            while j < len(text) and text[j].isalpha():
                j += 1
        if j > i:
            out.append(text[i:j].lower())
        i = max(j, i + 1)
    return out


def plain_dice(unit, known):
    """The best template of all, compared one by one."""
    w = plain_words(unit)
    g = {w[i] + " " + w[i + 1] for i in range(len(w) - 1)}
    scored = [(2 * len(g & o) / (len(g) + len(o)), len(o - g), k) for k, o in known if g]
    near = [(-round(d, 2), missing, -d, k) for d, missing, k in scored if d >= 0.8]
    return (-min(near)[2], min(near)[3]) if near else None


def test_licenses(spark, docs, empty):
    known = []
    for k, t in license.templates():
        w = plain_words(t)
        known.append((k, {w[i] + " " + w[i + 1] for i in range(len(w) - 1)}))
    mit = license.TEXTS["MIT"]
    legal = {k: t for k, t in license.templates() if len(t) > 5000}
    texts = ["Intro\nReleased under the MIT License.\nMore", mit, "x\n\n" + mit[:200] + "\n" + mit[200:] + "\n\nrest of it", "licensed under cc by-nc 4.0", "MIT", "", None, "a. a, a; " * 300, "Licensed under the Apache License, Version 2.0 (the thing)"]
    texts += [t for _, t in license.WHOLE] + [t[:3000] + t[3100:] for t in legal.values()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license.licenses(df).collect()}
    for i, t in enumerate(texts):
        blocks, open_ = [], []
        for line in [*(t or "").split("\n"), ""]:
            if line.strip():
                open_.append(line)
            else:
                blocks, open_ = [*blocks, "\n".join(open_)] if len(open_) > 1 else blocks, []
        units = [u for u in dict.fromkeys([*(t or "").split("\n"), *blocks, t or ""])]
        found = [b for u in units if (b := plain_dice(u, known))]
        assert set(got[i].licenses) >= {k for _, k in found} and (got[i].dice or 0) >= max((s for s, _ in found), default=0) - 1e-9
        if len(texts[i] or "") < 5000:
            assert got[i].licenses == sorted({k for _, k in found}) and (got[i].dice or 0) == pytest.approx(max((s for s, _ in found), default=0))
    for i, (k, _) in enumerate(license.WHOLE):
        assert (got[9 + i].license, got[9 + i].dice) == (k, 1.0)
    assert [got[9 + len(license.WHOLE) + i].license for i in range(len(legal))] == list(legal)
    assert got[0].license == "MIT" and texts[0][got[0].start : got[0].end] == "Released under the MIT License." and got[2].license == "MIT" and got[3].license == "CC-BY-NC-4.0"
    assert license.licenses(docs).count() == docs.count() and license.licenses(empty).count() == 0


def test_licenses_within_lines_and_across_blocks():
    scanner = license.Scanner(license.templates(), license.THRESHOLD)
    inside = {"Copyright 2020 Foo Inc. Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Foo is free software. Released under the MIT License.": "MIT", "This project is released under the MIT License.": "MIT"}
    for text, want in inside.items():
        assert [(f[0], f[1]) for f in scanner.scan(text)] == [(1.0, want)]
    both = scanner.scan("Code is released under the MIT License, and its many pictures are licensed under CC BY-NC 4.0, as said before.")
    assert [f[1] for f in both] == ["MIT", "CC-BY-NC-4.0"]
    a = license.TEXTS["Apache-2.0"]
    cut = a.index("You may"), a.index("Unless")
    text = "Copyright 2020 Foo\n\n" + "\n\n".join([a[: cut[0]], "    " + a[cut[0] : cut[1]], a[cut[1] :]]) + "\n\n" + " ".join(f"other{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200))
    top = max(scanner.scan(text))
    assert top[:2] == (1.0, "Apache-2.0") and text[top[2] : top[3]].startswith("Licensed under") and text[top[2] : top[3]].endswith("under the License")
    whole = dict(license.WHOLE)["BSD-3-Clause"]
    assert {f[1] for f in scanner.scan("Some file " + whole + " more " * 3 + " ".join(f"code{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)))} == {"BSD-3-Clause"}
    assert scanner.scan("the software and the license under which this is released " * 50) == []


# -- 9 toxicity ---------------------------------------------------------------------------------------------------


def test_long_texts_have_the_same_features(monkeypatch):
    rng = random.Random(71)
    texts = pa.array([prose(rng, 300), None, "", prose(rng, 4), prose(rng, 250) + " ..... " * 40 + prose(rng, 60)])
    model = toxicity.Ftrl()
    whole = toxicity._features(texts, model)
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 300)
    pieces = toxicity._features(texts, model)
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces, strict=True)) and len(common.long_pieces(texts, 300)[0]) > 10


def test_toxicity(spark, empty):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        t = prose(rng, rng.randrange(10, 60))
        rows.append((i, t + (f" zonk{rng.choice('abcdefg')}{rng.choice('xyz')}er you" * 2 if bad else ""), None, None, 0))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, None, None, None), (1001, "", None, None, 0), (None, "text", None, None, 0), rows[3]]
    labels += [(2000, 1, 1), (3, 1, None), (None, 0, 1)]
    docs = spark.createDataFrame(rows, DOC).withColumn("toxic", F.lit(1)).withColumn("score", F.lit("x"))
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, given).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.doc_id for r in got if r.held_out} == {d for d, *_ in rows if d is not None and zlib.crc32(str(d).encode()) % 5 == 0}
    held = [r for r in got if r.held_out and r.doc_id < 600]
    right = sum((r.doc_id % 5 == 0) == bool(r.predicted) for r in held)
    assert right / len(held) > 0.97
    kept = toxicity.drop_toxic(docs, given)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1000, 1001, None}
    assert {r.predicted for r in toxicity.toxicity(docs, given.where("false")).collect()} == {0}
    assert toxicity.toxicity(empty, given).count() == 0


# -- 10 substrings ------------------------------------------------------------------------------------------------


def plain_repeats(rows, length):
    least = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        for j in range(len(b) - length + 1 if d is not None else 0):
            least[b[j : j + length]] = min(d, least.get(b[j : j + length], d))
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1 if d is not None else 0):
            if least[b[j : j + length]] < d:
                gone[j : j + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        yield d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept


@pytest.mark.parametrize("length,gram,hot", [(50, 20, substrings.HOT), (50, 20, 3), (12, 5, substrings.HOT), (12, 5, 0), (12, 5, 4)])
def test_repeats(docs, rows, empty, length, gram, hot):
    want = Counter((d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in plain_repeats(rows, length))
    assert Counter(map(tuple, substrings.repeats(docs, length, gram, digest=True, hot=hot).collect())) == want


@pytest.mark.parametrize("hot", [substrings.HOT, 2, 30])
def test_repeats_in_runs_of_few_letters(spark, hot):
    rng = random.Random(11)
    unit = "".join(rng.choice("ab") for _ in range(40))
    rows = [(i, "".join(rng.choice([unit, unit[:7], "a", "b" * 9, unit[3:30]]) for _ in range(rng.randrange(1, 20)))) for i in range(60)]
    want = Counter((d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in plain_repeats(rows, 20))
    got = substrings.repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20, 8, digest=True, hot=hot)
    assert Counter(map(tuple, got.collect())) == want


def test_many_ranges(docs, rows, monkeypatch):
    monkeypatch.setattr(substrings, "RANGE_BYTES", 3000)
    want = Counter((d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in plain_repeats(rows, 50))
    assert Counter(map(tuple, substrings.repeats(docs, digest=True).collect())) == want


@pytest.mark.parametrize("segment,crowd", [(400, 1 << 20), (1 << 20, 300), (130, 200)])
def test_long_and_crowded_texts(docs, rows, monkeypatch, segment, crowd):
    """Texts in segments, and copies of one doc_id looked at once, give what whole texts give; other columns stay with their rows."""
    monkeypatch.setattr(substrings, "RANGE_BYTES", 5000)
    monkeypatch.setattr(substrings, "LANES", 4)
    table = docs.unionByName(docs.where("doc_id in (0, 3, 44)").withColumn("source", F.lit("again"))).unionByName(docs.where("doc_id = 3"))
    more = [(r.doc_id, r.text) for r in table.collect()]
    want = Counter((d, n, r, s, hashlib.sha256(k).hexdigest()) for d, n, r, s, k in plain_repeats(more, 50))
    got = substrings.repeats(table, digest=True, keep=("source", "part"), segment=segment, crowd=crowd).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert Counter((r.doc_id, r._0, r._1) for r in got) == Counter((r.doc_id, r.source, r.part) for r in table.collect())


def test_a_very_long_text_and_many_equal_rows(spark):
    rng = random.Random(31)
    base = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    long = "".join(f"{i} {base[i * 37 % 100_000:][:2000]}" for i in range(12_000))
    assert len(long) > 20 << 20
    one = spark.createDataFrame([(9, long)], "doc_id long, text string")
    copies = spark.range(10_000).select(F.lit(3).cast("long").alias("doc_id"), F.lit(base[:1000]).alias("text"))
    got = substrings.digest(one.unionByName(copies)).collect()
    assert len(got) == 10_001 and {tuple(r)[1:4] for r in got if r.doc_id == 3} == {(1000, 0, 0)}
    first = next(r for r in got if r.doc_id == 9)
    # Only bytes of the first 1000 of base go, wherever a piece of 50 or more of them stands.
    parts, gone = base[:1000], bytearray(len(long))
    known = {parts[j : j + 50] for j in range(951)}
    for j in range(len(long) - 49):
        if long[j : j + 50] in known:
            gone[j : j + 50] = b"\1" * 50
    kept = bytes(c for c, g in zip(long.encode(), gone, strict=True) if not g)
    assert (first.n_bytes, first.n_removed, first.kept_sha256) == (len(long), sum(gone), hashlib.sha256(kept).hexdigest()) and first.n_removed > 0


def test_deduplicated(docs, rows, empty):
    got = substrings.deduplicated(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    want = Counter((d, k.decode("utf-8", "ignore")) for d, n, r, s, k in plain_repeats(rows, 50) if not r or k)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert substrings.deduplicated(empty).count() == 0


def test_suffix_sort_and_collisions(monkeypatch):
    rng = np.random.default_rng(12)
    data = rng.integers(0, 2, (300, 16)).astype(np.uint8)
    data[100:200] = data[:100]
    sizes = rng.integers(4, 17, 300)
    for i, n in enumerate(sizes):
        data[i, n:] = 0
    group = np.sort(rng.integers(0, 4, 300))

    def check():
        order, ext = substrings.suffix_sort(data, sizes, group)
        keys = [(group[i], data[i, : sizes[i]].tobytes()) for i in order]
        assert sorted(order.tolist()) == list(range(300)) and keys == sorted(keys)
        for k in range(1, 300):
            a, b = keys[k - 1], keys[k]
            same = next((j for j, (x, y) in enumerate(zip(a[1], b[1])) if x != y), min(len(a[1]), len(b[1]))) if a[0] == b[0] else 0
            assert ext[k] == same

    check()
    # With hashes that all collide the order comes from the bytes.
    monkeypatch.setattr(substrings, "prefix_hashes", lambda d: np.zeros((*d.shape[:-1], d.shape[-1] + 1), np.uint64))
    check()


# -- further columns --------------------------------------------------------------------------------------------------


CLASHES = {c: i for i, c in enumerate(("k1", "k2", "part", "key", "rank", "bucket", "row", "content", "number", "score", "_toxicity", "n_words", "kept", "left", "cleaned", "counts", "failed", "base_failed", "text_hash", "_0", "_row", "hash", "fp", "a.b", "times", "draw"))}


def test_values_of_clashing_columns_stay(spark):
    rng = random.Random(51)
    rows = [(i, prose(rng, 60)) for i in range(40)] + [(100, ""), (101, None), (None, prose(rng, 70))]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1000 + i).cast("int") for c, i in CLASHES.items()})
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    item = spark.createDataFrame([(1, rows[3][1])], "item_id long, text string").withColumns({c: F.lit("x") for c in ("iid", "n", "p", "tid", "words", "term")})
    kept = {"toxicity": toxicity.drop_toxic(docs, given), "near": simhash.keep_one(docs), "repeats": substrings.deduplicated(docs), "decontaminate": decontam.decontaminate(docs, item), "clean": quality.clean(docs)}
    for name, df in kept.items():
        assert df.columns[: len(docs.columns)] == docs.columns and df.dtypes[: len(docs.columns)] == docs.dtypes, name
        found = df.select(*(F.col(f"`{c}`") for c in docs.columns)).collect()
        assert found and all(tuple(r)[2:] == tuple(1000 + i for i in range(len(CLASHES))) for r in found), name
    assert 3 not in {r.doc_id for r in kept["decontaminate"].collect()} and kept["decontaminate"].count() == len(rows) - 1
    made = kept["clean"].columns[len(docs.columns) :]
    assert made == ["n_words_", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed_", "cleaned_", "left_", "kept_"]
    plain = {r.doc_id: tuple(r)[2:] for r in quality.clean(docs.select("doc_id", "text")).collect()}
    assert {r.doc_id: tuple(r)[len(docs.columns) :] for r in kept["clean"].collect()} == plain
    # Those that return tables of their own take no notice.
    own = docs.select("doc_id", "text")
    same = lambda a, b: Counter(map(repr, a.collect())) == Counter(map(repr, b.collect()))
    for f in (simhash.near_duplicates, license.licenses, lambda d: decontam.hits(d, item), lambda d: tokens.digest(tokens.token_table(d)), lambda d: packing.packed(d, digest=True), substrings.digest, lm.scores, lambda d: toxicity.toxicity(d, given)):
        assert same(f(docs), f(own))


# -- pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline(spark, rows, tmp_path):
    """Each stage against its operator's plain version, on what its predecessor kept."""
    import corpus_pipeline

    rng = random.Random(13)
    table = [(d, t, la, s, n) for d, t, la, s, n in rows if d is not None]
    table += [(2000 + i, prose(rng, 60) + (" zonkaxer you zonkbyer" if i % 4 == 0 else ""), "en", "s", None) for i in range(300)]
    labels = [(2000 + i, 1, int(i % 4 == 0)) for i in range(300)]
    passage = " ".join(table[-1][1].split()[:30])
    spark.createDataFrame(table, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.collect())
        assert name == "packing" or docs.dtypes == spark.read.parquet(f"{tmp_path}/documents.parquet").dtypes
    toxic, single, cut, clean, pieces = kept
    gone = {r[0] for r in table} - {r.doc_id for r in toxic}
    assert len(gone & {2000 + i for i in range(0, 300, 4)}) > 60 and not gone - {2000 + i for i in range(0, 300, 4)}
    assert len({(r.doc_id, r.text) for r in single}) == len(single) < len(toxic)
    want = Counter((d, k.decode("utf-8", "ignore")) for d, n, r, s, k in plain_repeats([(r.doc_id, r.text) for r in single], 50) if not r or k)
    assert Counter((r.doc_id, r.text or "") for r in cut) == want
    assert {r.doc_id for r in cut} - {r.doc_id for r in clean} == {2299}
    assert {r.doc_id for r in pieces} == {r.doc_id for r in clean} and sum(r.doc_tokens for r in pieces if r.start == 0) == sum(r.length for r in pieces)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(pieces)


def test_pipeline_of_awkward_tables(spark, tmp_path):
    """No document at all; no label and no item; documents without ids, texts and words."""
    import corpus_pipeline

    rng = random.Random(81)
    some = [(None, prose(rng, 80), "en", None, 1), (None, prose(rng, 90), None, "s", None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, None, None, None, None), (3, prose(rng, 70), "en", "s", 5), (3, prose(rng, 75), "en", "s", 5)]
    tables = {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, rows in (("none", []), ("some", some)):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, DOC).write.parquet(f"{at}/documents.parquet")
        for t, ddl in tables.items():
            spark.createDataFrame([], ddl).write.parquet(f"{at}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    # The three rows without words are one group, of which the least doc_id stays.
    assert Counter(r.doc_id for r in pieces if r.start == 0) == Counter([None, None, 1, 3, 3])
    assert [r.doc_tokens for r in pieces if r.doc_id == 1] == [1]


def test_substrings_hold_few_times_a_range_of_documents():
    import tracemalloc

    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in rng.integers(3, 12, 5000)]
    shared = [b" ".join(words[k] for k in rng.integers(0, len(words), 40)) for _ in range(300)]
    texts = []
    while sum(map(len, texts)) < substrings.RANGE_BYTES:
        own = b" ".join(words[k] for k in rng.integers(0, len(words), 300))
        texts.append(own + b" " + shared[rng.integers(len(shared))] + b" " + own[:900])
    n, size = len(texts), sum(map(len, texts))
    docs = pa.table([pa.array([0] * n, pa.int32()), pa.array(range(n)), pa.array(range(n)), pa.array(texts, pa.binary())], ["part", "doc_id", "rank", "text"])
    known = substrings._anchors_of(docs, 50, 20)[2]
    known = np.unique(known)
    candidates = pa.table({"part": pa.array([0], pa.int32()), "hash": [known[::3].astype("<u8").tobytes()], "hot": [np.zeros(len(known[::3]), np.uint8).tobytes()]})
    binary = {k: pa.nulls(1, pa.binary()) for k in ("ord", "pos", "first", "last")}
    found = candidates
    for name, column in binary.items():
        found = found.append_column(name, column)
    for step, given, most in ((substrings._around(128, 50, 20), (docs, candidates), 10), (substrings._applied(50, 20, False), (docs, found), 12)):
        tracemalloc.start()
        try:
            step(*given)
            assert tracemalloc.get_traced_memory()[1] < most * size
        finally:
            tracemalloc.stop()


def test_substrings_left_over_and_covered_are_those_of_plain_loops():
    rng = np.random.default_rng(6)
    for n in (0, 1, 7, 400):
        starts = rng.integers(0, max(n, 1), n // 3)
        ends = np.minimum(starts + rng.integers(1, 9, len(starts)), n)
        gone = np.zeros(n, bool)
        for a, b in zip(starts, ends, strict=True):
            gone[a:b] = True
        assert substrings._covered(n, starts, ends).tolist() == gone.tolist()
        data = rng.integers(97, 123, n).astype(np.uint8)
        offsets = np.sort(np.concatenate([[0, 0], rng.integers(0, n + 1, 6), [n, n]]))
        got = [x.to_pylist() for x in substrings._left_over(data, offsets, gone, False)]
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            own = gone[a:b].tolist()
            spans = sum(x and not (k and own[k - 1]) for k, x in enumerate(own))
            assert [c[i] for c in got] == [b - a, sum(own), spans, bytes(data[a:b][~gone[a:b]]).decode()]


def test_substrings_lots_keep_groups_whole():
    group = np.repeat(np.arange(9), [1, 5, 2, 2, 40, 1, 1, 7, 3])
    for most in (1, 4, 10, 100):
        lots = substrings._lots(group, most)
        assert [k for lot in lots for k in range(lot.start, lot.stop)] == list(range(len(group)))
        assert all(lot.stop - lot.start <= most or len(set(group[lot])) == 1 for lot in lots)
        assert all(a.stop == b.start and group[a.stop - 1] != group[b.start] for a, b in zip(lots, lots[1:], strict=False))
    assert substrings._lots(group[:0], 4) == []
