"""Benchmark decontamination over a distributed positional inverted index.

1. The index: postings (term, document, position) of all terms that the
   benchmark has, stored; their lengths are the terms' frequencies.
2. Each window of ``window`` item words takes its two rarest terms.  A window with
   a term that no document has cannot occur and takes none.
3. The lists of the two are adjusted by their distance in the window and
   intersected by document and place.  What is left are alignments of the item
   with the document.
4. The lists of all of the item's terms are intersected with the alignments' places:
   runs of ``window`` item words or more that are all in place are exact matches.

``near`` reads the same lists: documents with the two rarest terms of a window
within a given distance, in any order.  Texts are read once for the index and once
for the number of their words; no text or array of words is shuffled.

Only DataFrame expressions.  Terms, pairs of terms and candidate documents are
broadcast below a counted bound and joined by a shuffle beyond it; joins of lists
are by document and place, so no common term and no long document is one key.

Words are lower-cased at A-Z alone, in the index too: folding all of Unicode
depends on what follows a word (Greek final sigma) and would part equal words.

Defined results: null text and text without words: no words, no hit; items
without words match nothing; items with fewer words than a window are one
window; equal rows get equal results each; item ids that repeat count once; an
empty benchmark hits nothing, an empty table of documents gives an empty result;
further columns are ignored, and pass through ``decontaminate`` whatever their
names.  A text's words are one row's array when they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm.common import column, written
from weirflow.llm.quality import fresh

WINDOW = 13
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Rows of the benchmark's terms or of candidate keys that are broadcast at most (some tens of bytes each).
BROADCAST_ROWS = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def exact_words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), SEPARATOR), lambda w: w != "")


def small(df: DataFrame) -> DataFrame:
    """df with the broadcast hint if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _key() -> list[Column]:
    """Two numbers, equal for rows that are equal in doc_id and text, else different."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.xxhash64("text")]


def _keyed(docs: DataFrame) -> DataFrame:
    k1, k2 = _key()
    return docs.select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))


KEY = ["k1", "k2"]


def items_of(benchmark: DataFrame) -> DataFrame:
    """(iid, item_id, n, words): the array of the item's words."""
    rows = benchmark.select("item_id", exact_words(F.col("text")).alias("words")).where(F.size("words") > 0)
    return rows.select(F.xxhash64("item_id", "words").alias("iid"), "item_id", F.size("words").alias("n"), "words").dropDuplicates(["iid"])


def anchors_of(placed: DataFrame, frequencies: DataFrame, window: int = WINDOW) -> DataFrame:
    """(iid, t1, p1, t2, p2): the rarest and next rarest terms of windows and their places in the item; of one word it is both."""
    terms = placed.join(frequencies, "tid", "left")
    ahead = Window.partitionBy("iid").orderBy("p").rowsBetween(0, window - 1)
    rarity = F.struct(F.coalesce("frequency", F.lit(0)).alias("frequency"), "p", "tid")
    windows = terms.withColumn("ranked", F.slice(F.sort_array(F.collect_list(rarity).over(ahead)), 1, 2)).where(F.col("p") <= F.greatest(F.col("n") - window, F.lit(0)))
    first, second = F.col("ranked")[0], F.coalesce(F.get("ranked", F.lit(1)), F.col("ranked")[0])
    return windows.where(first["frequency"] > 0).select("iid", first["tid"].alias("t1"), first["p"].alias("p1"), second["tid"].alias("t2"), second["p"].alias("p2")).distinct()


class Index:
    """The stored postings of the benchmark's terms, and the terms that its windows are looked up by."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW):
        self.window = window
        self.keyed = _keyed(docs)
        self.items = written(items_of(benchmark), "items")
        terms = self.items.select(F.explode("words").alias("term")).distinct()
        terms = written(terms.select("term", F.monotonically_increasing_id().alias("tid")), "terms")
        words = self.keyed.where(F.col("text").isNotNull()).select(*KEY, F.posexplode(exact_words(F.col("text"))).alias("pos", "term"))
        self.postings = written(words.join(small(terms), "term").select("tid", *KEY, "pos"), "postings")
        frequencies = self.postings.groupBy("tid").agg(F.count("*").alias("frequency"))
        #: Each item's words: iid, n, p, tid.
        self.placed = written(self.items.select("iid", "n", F.posexplode("words").alias("p", "term")).join(terms, "term").select("iid", "n", "p", "tid"), "placed")
        self.anchors = written(anchors_of(self.placed, frequencies, window), "anchors")

    def lists(self, column: str) -> DataFrame:
        """The postings of the anchors' terms in that column, each once."""
        wanted = self.anchors.select(F.col(column).alias("tid")).distinct()
        return self.postings.join(small(wanted), "tid").distinct()

    def alignments(self) -> DataFrame:
        """(k1, k2, iid, shift): both of a window's rarest terms stand where the item's words would, its word p at shift + p."""
        pairs = self.anchors.select("t1", "t2", (F.col("p2") - F.col("p1")).alias("apart")).distinct()
        pairs = written(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs")
        known = small(pairs)
        first = self.lists("t1").join(known, F.col("tid") == F.col("t1")).select(*KEY, "pair", "t1", "t2", "apart", (F.col("pos") + F.col("apart")).alias("at"))
        second = self.lists("t2").join(known, F.col("tid") == F.col("t2")).select(*KEY, "pair", F.col("pos").alias("at"))
        both = first.join(second, [*KEY, "pair", "at"], "left_semi")
        anchors = self.anchors.select("iid", "t1", "t2", "p1", (F.col("p2") - F.col("p1")).alias("apart"))
        return both.join(anchors, ["t1", "t2", "apart"]).select(*KEY, "iid", (F.col("at") - F.col("apart") - F.col("p1")).alias("shift")).distinct()

    def matches(self) -> DataFrame:
        """(k1, k2, item_id, places): the document's word places within exact occurrences of the item's windows."""
        found = written(self.alignments(), "alignments")
        lists = self.postings.join(small(found.select(*KEY).distinct()), KEY, "left_semi")
        expected = found.join(self.placed, "iid").select(*KEY, "iid", "shift", "n", "p", "tid", (F.col("shift") + F.col("p")).alias("pos"))
        there = expected.join(lists, [*KEY, "tid", "pos"], "left_semi")
        placed = there.groupBy(*KEY, "iid", "shift", "n").agg(F.sort_array(F.collect_list("p")).alias("ps"))
        starts = lambda ps: F.filter(ps, lambda x, i: ~F.get(ps, i - 1).eqNullSafe(x - 1))
        ends = lambda ps: F.filter(ps, lambda x, i: ~F.get(ps, i + 1).eqNullSafe(x + 1))
        size = F.least(F.col("n"), F.lit(self.window))
        runs = F.filter(F.zip_with(starts(F.col("ps")), ends(F.col("ps")), lambda a, b: F.struct(a.alias("first"), b.alias("last"))), lambda r: r["last"] - r["first"] + 1 >= size)
        whole = placed.withColumn("runs", runs).where(F.size("runs") > 0)
        places = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"] + F.col("shift"), r["last"] + F.col("shift"))))
        return whole.join(self.items.select("iid", "item_id"), "iid").select(*KEY, "item_id", places.alias("places"))

    def near(self, distance: int) -> DataFrame:
        """(k1, k2, item_id): documents with both rarest terms of a window of the item within so many words, each once."""
        pairs = written(self.anchors.select("t1", "t2").distinct(), "pairs")
        known, reach = small(pairs), distance + 1
        block = F.floor(F.col("pos") / reach)
        # Within a block there are reach places at most, so a block is no hot key.
        first = self.lists("t1").join(known, F.col("tid") == F.col("t1")).select(*KEY, "t1", "t2", F.col("pos").alias("pos1"), F.explode(F.array(block - 1, block, block + 1)).alias("block"))
        second = self.lists("t2").join(known, F.col("tid") == F.col("t2")).select(*KEY, "t1", "t2", F.col("pos").alias("pos2"), block.alias("block"))
        met = first.join(second, [*KEY, "t1", "t2", "block"]).where(F.abs(F.col("pos1") - F.col("pos2")) <= distance).select(*KEY, "t1", "t2").distinct()
        items = self.anchors.join(self.items.select("iid", "item_id"), "iid").select("t1", "t2", "item_id").distinct()
        return met.join(items, ["t1", "t2"]).select(*KEY, "item_id").distinct()

    def proximity(self, distance: int) -> DataFrame:
        """(doc_id, item_id) of near."""
        return self.keyed.select("doc_id", *KEY).join(self.near(distance), KEY).select("doc_id", "item_id")


def _ids(found: DataFrame, name: str) -> DataFrame:
    """(k1, k2, name): the item ids of each document, sorted as strings."""
    return found.select(*KEY, F.col("item_id").cast("string").alias("id")).distinct().groupBy(*KEY).agg(F.sort_array(F.collect_list("id")).alias(name))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, distance: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, item_ids, contaminated; with a distance also near_ids.

    item_ids are the items with exact matches, near_ids those with the two rarest
    terms of a window within the distance; both sorted as strings.
    """
    index = Index(docs, benchmark, window)
    matches = written(index.matches(), "matches")
    places = matches.select(*KEY, F.explode("places").alias("place")).distinct().groupBy(*KEY).agg(F.count("*").alias("n_hit"))
    counted = index.keyed.select("doc_id", *KEY, F.greatest(F.coalesce(F.size(exact_words(F.col("text"))), F.lit(0)), F.lit(0)).cast("long").alias("n_words"))
    known = places.join(_ids(matches, "item_ids"), KEY)
    none = F.array().cast("array<string>")
    more = []
    if distance is not None:
        known = known.join(_ids(index.near(distance), "near_ids"), KEY, "full")
        more = [F.coalesce("near_ids", none).alias("near_ids")]
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    contaminated = (n_hit > 0) & (20 * n_hit >= F.col("n_words"))
    return counted.join(written(known, "hits"), KEY, "left").select("doc_id", *KEY, "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), contaminated.alias("contaminated"), *more)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without the contaminated ones."""
    bad = hits(docs.select("doc_id", "text"), benchmark, window).where("contaminated").select(*KEY).distinct()
    own = fresh(KEY, docs.columns)
    bad = written(bad.toDF(*own), "contaminated")
    return docs.withColumns(dict(zip(own, _key(), strict=True))).join(small(bad), own, "left_anti").select(*(column(c) for c in docs.columns))
