"""Quality rules: line-first cleaning, then rejection of documents that lose too much text.

Each line passes or fails by rules on its punctuation (marks and shouting),
on navigation (items between bars) and on boilerplate phrases and repetition.
Failing lines are removed.  A document is kept if the base rule holds and
enough of its text is left.  All of it is DataFrame expressions on one row: no
shuffle, no Python.

Words are maximal runs of anything but 0x20 and 0x09-0x0D; lines are split at
\\n.  Defined results: null text has no words (all counts 0, base_failed true)
and cleans to the empty text; repeated rows are judged each; a text is one row's
arrays of words and windows, some ten times its size, so texts of some 100 MB are
the limit; an empty table gives an empty result; further columns pass through
``clean`` untouched, also those named like a result, which then is named with
underscores after it (``fresh``).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Phrases of site furniture, not of prose.
BOILERPLATE = (
    "accept all cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "privacy policy",
    "sign up for our newsletter", "skip to content", "subscribe to our", "terms of service", "terms of use",
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A line fails with more symbols than this part of its characters.
    max_symbols: float = 0.1
    #: ... with this many bars at least, where one comes for every bar_words words or fewer.
    min_bars: int = 3
    bar_words: int = 6
    #: ... with an exclamation mark for this many words or fewer, of shout_words words or more.
    shout_every: int = 2
    shout_words: int = 6
    #: ... with under this part of distinct words, of repeat_words words or more.
    min_distinct: float = 0.3
    repeat_words: int = 8
    #: A document goes that keeps under this part of its word characters.
    min_left: float = 0.7


def let(value: Column, body) -> Column:
    """body(value), value evaluated once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def line_passes(line: Column, rules: Rules) -> Column:
    n = F.length(line)
    phrases = "(?i)" + "|".join(BOILERPLATE)

    def judged(words: Column) -> Column:
        count = F.size(words)
        bars, shouts = F.regexp_count(line, F.lit("\\|")), F.regexp_count(line, F.lit("!"))
        return ~(
            (F.regexp_count(line, F.lit(SYMBOLS)) > n * F.lit(rules.max_symbols))
            | ((bars >= rules.min_bars) & (bars * rules.bar_words >= count))
            | ((count >= rules.shout_words) & (shouts * rules.shout_every >= count))
            | ((count >= rules.repeat_words) & (F.size(F.array_distinct(words)) < count * F.lit(rules.min_distinct)))
            | line.rlike(phrases)
        )

    return let(words_of(line), judged)


def repeated_words(words: Column) -> Column:
    """Words that lie in 3-word windows which occur twice or more (words may be null: 0).

    Windows are sorted by hash; those whose neighbour has the same hash and the
    same words are marked; the marked windows, in order, cover up to three words
    each.
    """

    def windows(w: Column) -> Column:
        return F.slice(F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))), 1, F.greatest(F.size(w) - 2, F.lit(0)))

    def marked(s: Column, w: Column) -> Column:
        word = lambda x, k: F.get(w, x["i"] + k)
        same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2)), F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, j: F.least(F.coalesce(F.get(at, j + 1) - x, F.lit(3)), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(let(F.sort_array(windows(words)), lambda s: marked(s, words)), covered))


def fresh(names: Iterable[str], taken: Iterable[str]) -> list[str]:
    """names, each with as many underscores after it as make it no taken one (whatever the case of letters)."""
    used, found = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        found.append(name)
    return found


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _counts(text: Column) -> Column:
    """A struct of COUNTS of a text that is not null."""
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            lines.cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """docs with the counts, base_failed, cleaned (the passing lines), left (part of word characters left) and kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cleaned = F.array_join(F.filter(F.split(text, "\n"), lambda x: line_passes(x, rules)), "\n")
    c, out, failed, left = fresh(("counts", "cleaned", "failed", "left"), docs.columns)
    n = F.col(c)["n_words"]
    bad = (n < rules.min_words) | (F.lit(100) * F.col(c)["n_repeat_words"] > F.lit(rules.max_repeat_percent) * n)
    part = F.when(F.col(c)["word_chars"] > 0, F.length(F.regexp_replace(out, SPACE, "")) / F.col(c)["word_chars"]).otherwise(F.lit(0.0))
    judged = docs.withColumns({c: _counts(text), out: cleaned}).withColumns({failed: bad, left: part})
    results = [*(F.col(c)[name] for name in COUNTS), F.col(failed), F.col(out), F.col(left), ~F.col(failed) & (F.col(left) >= rules.min_left)]
    names = fresh((*COUNTS, "base_failed", "cleaned", "left", "kept"), docs.columns)
    return judged.select(*(F.col("`" + x.replace("`", "``") + "`") for x in docs.columns), *(r.alias(x) for r, x in zip(results, names, strict=True)))
