"""Exploration: missing values, descriptions, correlations, histograms."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.scalars import finite, quoted
from weirflow.operators.ordering import join_on, percentiles


def _long(df: DataFrame, by: Sequence[str], columns: Sequence[str], name: str = "column") -> DataFrame:
    return df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("n"), finite(quoted(c).cast("double")).alias("v")) for c in columns))).alias("_x")).select(*by, F.col("_x.n").alias(name), F.col("_x.v").alias("value"))


def missing_rates(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, missing): part of rows without a value, 1 for no rows; one aggregation, unpivoted after it."""
    rates = [F.coalesce(F.avg(finite(quoted(c).cast("double")).isNull().cast("double")), F.lit(1.0)).alias(f"_{i}") for i, c in enumerate(columns)]
    wide = df.groupBy(*by).agg(*rates)
    return wide.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("missing")) for i, c in enumerate(columns)))).alias("_x")).select(*by, "_x.*")


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, column, n, mean, std, min, q25, q50, q75, max); std is the sample's, quartiles are exact."""
    long = _long(df, by, columns)
    keys = [*by, "column"]
    found = long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    q = percentiles(long, "value", (0.25, 0.5, 0.75), keys).select(*keys, "q", "low", "high")
    both = join_on(found, q, keys, "left")
    return both.select(*keys, "n", "mean", "std", F.col("low").alias("min"), F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), F.col("high").alias("max"))


def _pairs_long(wide: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(rows).alias("_x")).select("_x.*")


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r) for each pair of columns, over rows that have both; all pairs in one aggregation."""
    pairs = list(combinations(columns, 2))
    return _pairs_long(df.agg(*(F.corr(finite(quoted(a).cast("double")), finite(quoted(b).cast("double"))).alias(f"_{i}") for i, (a, b) in enumerate(pairs))), pairs)


def average_ranks(df: DataFrame, value: str, by: Sequence[str], out: str, buckets: int = 64) -> DataFrame:
    """(by, value, out): the average rank of each distinct value among the rows of by.

    Ranks come from the counts of distinct values: summed within buckets of
    values (bounded by approximate quantiles, so a bucket holds a share of the
    values, exact in any case), and the buckets' totals before them.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_k"))
    at = F.percentile_approx(value, F.array(*(F.lit(i / buckets) for i in range(1, buckets))), F.lit(1000)).alias("_bounds")
    bounds = F.broadcast(counts.groupBy(*by).agg(at))  # one row for each group of columns
    both = join_on(counts, bounds, by)
    placed = both.withColumn("_b", F.size(F.filter("_bounds", lambda q: q < F.col(value)))).drop("_bounds")
    totals = placed.groupBy(*by, "_b").agg(F.sum("_k").alias("_n"))
    before = totals.select(*by, "_b", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n")).alias("_before"))
    upto = F.sum("_k").over(Window.partitionBy(*by, "_b").orderBy(value))
    return join_on(placed.withColumn("_upto", upto), F.broadcast(before), [*by, "_b"]).select(*by, value, (F.col("_before") + F.col("_upto") - (F.col("_k") - 1) / 2).alias(out))


#: A value is common if more than this part of its column's rows have it; so there are COMMON at most for a column.
COMMON = 1000


def spearman(df: DataFrame, columns: Sequence[str], buckets: int = 64) -> DataFrame:
    """(a, b, r): Pearson of average ranks among the rows that have both; NULL where a column does not vary.

    Ranks differ by pair where values miss.  Equal rows are counted first, then each
    column's distinct values, for every other column of the rows that have it too.  Only
    these counts are ordered, once a column, in buckets, by running sums: a value's ranks
    for all its pairs come from that one order.  The rows meet the ranks of their
    values, common values by a broadcast, so that no task gets all rows of one value.
    What is shuffled are a row's columns, not its pairs.
    """
    k, names = len(columns), [f"c{i}" for i in range(len(columns))]
    if k < 2:
        raise ValueError("two columns at least")
    values = df.select(*(finite(quoted(c).cast("double")).alias(n) for c, n in zip(columns, names, strict=True)))
    values = values.withColumns({n: F.col(n) + F.lit(0.0) for n in names})  # -0.0 is 0.0
    rows = values.groupBy(*names).agg(F.count("*").alias("times"))
    # A row by 128 bits of hashes; which columns it has by a bit each.
    there = [F.col(n).isNotNull() for n in names]
    keyed = rows.select(F.xxhash64(*names, *there).alias("h1"), F.xxhash64(F.lit(1), *names, *there).alias("h2"), "times", F.array(*(t.cast("byte") for t in there)).alias("has"), *names)
    cells = keyed.select("h1", "h2", "times", "has", F.posexplode(F.array(*names)).alias("col", "x")).where("x IS NOT NULL")
    counts = cells.groupBy("col", "x").agg(F.count("*").alias("n"), *(F.sum(F.col("times") * F.col("has")[j]).alias(f"n{j}") for j in range(k)))
    # Bounds from the values of least hashes: plans that are computed twice find the same ones, which percentile_approx does not promise.
    place = F.row_number().over(Window.partitionBy("col").orderBy(F.xxhash64("col", "x"), "x"))
    some = counts.select("col", "x", place.alias("place")).where(F.col("place") <= 32 * buckets)
    bounds = some.groupBy("col").agg(F.percentile("x", F.array(*(F.lit(i / buckets) for i in range(1, buckets)))).alias("bounds"))  # a row a column
    cells_of = counts.groupBy("col").agg(F.sum("n").alias("cells"))
    placed = counts.join(F.broadcast(bounds), "col").withColumn("bucket", F.size(F.filter("bounds", lambda q: q < F.col("x")))).drop("bounds")
    placed = placed.join(F.broadcast(cells_of), "col").withColumn("common", F.col("n") * COMMON > F.col("cells")).drop("cells")
    held = placed.groupBy("col", "bucket").agg(*(F.sum(f"n{j}").alias(f"n{j}") for j in range(k)))
    upto = Window.partitionBy("col").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("col", "bucket", F.array(*(F.coalesce(F.sum(f"n{j}").over(upto), F.lit(0)) for j in range(k))).alias("before"))
    inside = Window.partitionBy("col", "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    within = placed.select("col", "bucket", "x", "common", F.array(*(F.sum(f"n{j}").over(inside) - (F.col(f"n{j}") - 1) / 2 for j in range(k))).alias("within"))
    ranked = within.join(F.broadcast(before), ["col", "bucket"]).select("col", "x", "common", F.zip_with("before", "within", lambda b, w: b + w).alias("ranks"))

    common = F.broadcast(ranked.where("common").select("col", "x", "ranks"))
    rare = cells.join(common.drop("ranks"), ["col", "x"], "left_anti").join(ranked.where("NOT common").drop("common"), ["col", "x"])
    of_rows = cells.join(common, ["col", "x"]).unionByName(rare).select("h1", "h2", "times", "col", "ranks")
    whole = of_rows.groupBy("h1", "h2").agg(F.max("times").alias("times"), F.map_from_entries(F.collect_list(F.struct("col", "ranks"))).alias("ranks"))
    totals = counts.groupBy("col").agg(*(F.sum(f"n{j}").alias(f"n{j}") for j in range(k)))
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in combinations(range(k), 2)))
    counts = totals.select(F.col("col").alias("i"), F.posexplode(F.array(*(f"n{j}" for j in range(k)))).alias("j", "n")).where("i < j").groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.struct("i", "j"), "n"))).alias("n"))
    sides = F.transform(pairs, lambda p: F.struct(F.get(F.element_at("ranks", p["i"]), p["j"]).alias("u"), F.get(F.element_at("ranks", p["j"]), p["i"]).alias("v"), ((F.element_at("n", p) + 1) / 2).alias("m")))
    wide = whole.crossJoin(F.broadcast(counts)).select("times", sides.alias("s"))  # one row of the pairs' counts
    sums = []
    for q in range(k * (k - 1) // 2):
        s = F.col("s")[q]
        u, v = s["u"] - s["m"], s["v"] - s["m"]  # ranks of n rows are around (n + 1) / 2
        sums += [F.sum(F.when(s["u"].isNotNull() & s["v"].isNotNull(), F.col("times") * e)).alias(f"{name}{q}") for name, e in (("xy", u * v), ("xx", u * u), ("yy", v * v))]
    one = wide.agg(*sums)
    return _pairs_long(one.select(*(F.when((F.col(f"xx{q}") > 0) & (F.col(f"yy{q}") > 0), F.col(f"xy{q}") / F.sqrt(F.col(f"xx{q}") * F.col(f"yy{q}"))).alias(f"_{q}") for q in range(k * (k - 1) // 2))), list(combinations(columns, 2)))


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: n_rows and n_complete."""
    complete: Column = F.lit(True)
    for c in columns:
        complete = complete & finite(quoted(c).cast("double")).isNotNull()
    return df.agg(F.count("*").alias("n_rows"), F.count_if(complete).alias("n_complete"))


def histogram(df: DataFrame, value: str, bins: int = 80) -> DataFrame:
    """(bucket, low, high, n): equal widths from min to max, the last bin closed; all values equal are in the first."""
    v = finite(quoted(value).cast("double"))
    rows = df.select(v.alias("v")).where("v is not null")
    span = F.broadcast(rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))  # one row
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1, F.lit(bins))).otherwise(1).cast("int")
    width = (F.col("hi") - F.col("lo")) / bins
    counts = rows.crossJoin(span).groupBy(place.alias("bucket")).agg(F.count("*").alias("n"))
    every = span.where("lo is not null").select("lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", (F.col("lo") + (F.col("bucket") - 1) * width).alias("low"), (F.col("lo") + F.col("bucket") * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))
