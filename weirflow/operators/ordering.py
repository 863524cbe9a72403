"""Row order at scale: numbering without one task that holds all rows, and frames over chunks with a halo."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from weirflow.functions.scalars import micros

#: Rows of a chunk; a chunk is what one task sorts for its frames.
CHUNK_ROWS = 1 << 16
#: Length of a slice in which rows are numbered: an hour.
SLICE_MICROS = 3_600_000_000


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined to right on equal keys, where NULL equals NULL; the keys come once.  Without keys right is one row, broadcast."""
    if not keys:
        return left.crossJoin(F.broadcast(right)) if how == "inner" else left.join(F.broadcast(right), F.lit(True), how)
    other = right.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`_on_{k}`"))
    return left.join(other, on, how).drop(*(f"_on_{k}" for k in keys))


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence) -> DataFrame:
    """One row for each key, the first in the order.  An aggregation: it combines before the shuffle and holds one row a key."""
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return df.groupBy(*key).agg(F.min_by(whole, F.struct(*order)).alias("_row")).select("_row.*")


def numbered(df: DataFrame, ts: str, tie: Sequence[str] = (), keys: Sequence[str] = (), name: str = "_r", slice_micros: int = SLICE_MICROS) -> DataFrame:
    """df with the place of each row (from 0) among the rows of its keys, by ts and tie, which must order them uniquely.

    Rows are numbered within slices of time, and slices by their counts; only
    the counts pass through one ordered window.  Slices depend on the time
    alone, so a recomputed task numbers alike.  Rows without a time go; a NULL key is a key.
    """
    rows = df.where(F.col(ts).isNotNull()).withColumn("_slice", F.floor(micros(F.col(ts)) / F.lit(slice_micros)))
    counts = rows.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_slice")) - F.col("_n")
    bases = counts.select(*keys, "_slice", before.alias("_base"))
    within = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(ts, *tie)) - 1
    return join_on(rows.withColumn("_i", within), bases, [*keys, "_slice"]).withColumn(name, F.col("_base") + F.col("_i")).drop("_slice", "_i", "_base")


def percentiles(df: DataFrame, value: str, ps: Sequence[float], by: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """(by, n, q, low, high): the exact percentiles ps of the values that are there, interpolated, as an array; least and largest value.

    Distinct values are counted and placed in buckets by approximate quantiles;
    the buckets' totals tell which of them hold the wanted ranks, and only these
    are ordered.  So no task holds all values of a group.  Without keys there is
    one row in any case: n is 0 and the rest NULL where no value is there.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    at = F.percentile_approx("_v", F.array(*(F.lit(i / buckets) for i in range(1, buckets))), F.lit(1000)).alias("_bounds")
    whole = counts.groupBy(*by).agg(at, F.sum("_k").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    with_ = lambda left, right: join_on(left, right, by)
    placed = with_(counts, whole.select(*by, "_bounds")).select(*by, "_v", "_k", F.size(F.filter("_bounds", lambda q: q < F.col("_v"))).alias("_b"))
    totals = placed.groupBy(*by, "_b").agg(F.sum("_k").alias("_n"))
    before = totals.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n"))
    ranks = [F.lit(float(p)) * (F.col("n") - 1) for p in ps]
    inside = lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n"))
    wanted = F.lit(False)
    for r in ranks:
        wanted = wanted | inside(F.floor(r)) | inside(F.ceil(r))
    held = with_(before, whole.select(*by, "n")).where(wanted).select(*by, "_b", "_before", "n")
    upto = F.sum("_k").over(Window.partitionBy(*by, "_b").orderBy("_v"))
    few = join_on(placed, held, [*by, "_b"]).withColumn("_upto", F.col("_before") + upto)
    ends = [F.min(F.when(F.col("_upto") > f(r), F.col("_v"))) for r in ranks for f in (F.floor, F.ceil)]
    picked = few.groupBy(*by).agg(F.max("n").alias("n"), *(e.alias(f"_e{i}") for i, e in enumerate(ends)))
    between = [F.col(f"_e{2 * i}") + (r - F.floor(r)) * (F.col(f"_e{2 * i + 1}") - F.col(f"_e{2 * i}")) for i, r in enumerate(ranks)]
    return with_(picked.select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.array(*between).alias("q")), whole.select(*by, "low", "high"))


def in_chunks(df: DataFrame, row: str, before: int, after: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """df with _home and _chunk: each row in its own chunk of rows and, within the halo, in the neighbours."""
    size = max(chunk_rows, before + 1, after + 1)
    home = F.floor(F.col(row) / size).cast("long")
    within = F.pmod(F.col(row), F.lit(size))
    # A row that is within `before` of its chunk's end is context for the next chunk, and so on.
    chunks = F.array_compact(F.array(home, F.when(within >= size - before, home + 1), F.when(within < after, home - 1)))
    return df.withColumn("_home", home).withColumn("_chunk", F.explode(chunks))


def over_chunks(df: DataFrame, row: str, before: int, after: int, compute: Callable[[DataFrame, WindowSpec], DataFrame], keys: Sequence[str] = (), chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """compute(df, window) for frames that reach at most before rows back and after rows ahead.

    window is partitioned by chunk (and keys) and ordered by row.  Each row goes
    to its chunk and, within the halo, to the neighbours; results are taken from
    the own chunk alone.
    """
    copied = in_chunks(df, row, before, after, chunk_rows)
    done = compute(copied, Window.partitionBy("_chunk", *keys).orderBy(row))
    return done.where(F.col("_chunk") == F.col("_home")).drop("_chunk", "_home")
