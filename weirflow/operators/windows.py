"""Sliding windows of a context and a future, as arrays or in long form.

For L context rows, shift h, P future rows and stride S, a window starts at
every S-th row i of its series with i <= n - L - h - P; its anchor is the row
e = i + L - 1 and its future the rows e + h + 1 .. e + h + P.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.functions.scalars import finite, micros, quoted, weight
from weirflow.operators.ordering import in_chunks, join_on, numbered, over_chunks, percentiles

#: Rows of a chunk from which windows are cut, about; longer windows take longer chunks.
WINDOW_CHUNK = 2048
#: Rows that the windows made at once hold, about.
CUT_ROWS = 1 << 17

# The data set's weights, and the name of a single one.
WEIGHTS = ("weight_chl_gt", "weight")


@dataclass(frozen=True)
class WindowSettings:
    context: int = 96
    shift: int = 0
    future: int = 48
    stride: int = 1
    skip_null_target: bool = True
    #: A step of over max_gap median steps within a window drops it; None: no test.
    max_gap: float | None = 2.0

    def __post_init__(self):
        if min(self.context, self.future, self.stride) < 1 or self.shift < 0:
            raise ValueError("context, future and stride must be at least 1, shift at least 0")


def weight_column(columns: Sequence[str]) -> str | None:
    """The weight that windows take: on the grid if there, else of the samples, else none (all ones).

    A table whose weights have other names needs the name given: they are not passed over.
    """
    found = next((c for c in (*(f"{w}_resampled" for w in WEIGHTS), *WEIGHTS) if c in columns), None)
    if found is None and (others := [c for c in columns if c.startswith("weight")]):
        raise ValueError(f"which of {others} is the weight of windows? name it by weight_col")
    return found


def median_step(df: DataFrame, ts: str, tie: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """(keys, step): the median positive time between the rows of a series in microseconds, truncated."""
    return _median_step(numbered(df.select(*keys, ts, *tie), ts, tie, keys), ts, keys)


def _median_step(rows: DataFrame, ts: str, keys: Sequence[str]) -> DataFrame:
    gaps = over_chunks(rows.select(*keys, ts, "_r"), "_r", 1, 0, lambda d, w: d.withColumn("_gap", micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(w)), keys)
    return percentiles(gaps.where("_gap > 0"), "_gap", (0.5,), keys).where("n > 0").select(*keys, F.floor(F.col("q")[0]).cast("long").alias("step"))


def sliding(df: DataFrame, ts: str, features: Sequence[str], target: str, s: WindowSettings = WindowSettings(), keys: Sequence[str] = ("split",), weight_col: str | None = None, tie: Sequence[str] = (), chunk_rows: int = WINDOW_CHUNK) -> DataFrame:
    """A row for each window: keys, window_id, context_end, end_value, context, future.

    window_id is the start row within the series.  context is an array of
    (features..., target), future of (ts, y, w).  NULL is missing; the weight of
    a missing weight is 0, without a weight column all weights are 1.  Series
    are the rows of equal keys (NULL is a key), ordered by ts and tie; gaps are
    judged by the series' own median step.

    Rows are gathered in sorted chunks, each with the rows that its last window
    reaches; windows are slices of these, made for every stride-th start alone, and
    rows that no window holds are not gathered.
    """
    used = weight_col or weight_column(df.columns)
    w = weight(quoted(used).cast("double")) if used else F.lit(1.0)
    value = lambda c: finite(quoted(c).cast("double"))
    slim = df.select(*keys, ts, *tie, F.struct(*(value(c).alias(f"f{i}") for i, c in enumerate(features)), value(target).alias("y")).alias("_x"), w.alias("_w"))
    rows = numbered(slim, ts, tie, keys)
    gap_limit = _median_step(rows, ts, keys) if s.max_gap is not None else None
    span = s.context + s.shift + s.future
    if s.stride > span:
        rows = rows.where(F.col("_r") % s.stride < span)
    apart = min(s.stride, span)  # rows that are kept from one window's start to the next one's
    per_chunk = max(chunk_rows, span) // s.stride + 1
    chunks = in_chunks(rows, "_r", 0, max(span - s.stride, 0), per_chunk * s.stride)
    step = F.lit(None).cast("long")
    if s.max_gap is not None:
        step = micros(F.col(ts)) - F.lag(micros(F.col(ts))).over(Window.partitionBy(*keys, "_chunk").orderBy("_r"))
    cells = F.struct("_r", F.col(ts).alias("ts"), "_x", F.col("_w").alias("w"), step.alias("gap"))
    held = chunks.select(*keys, "_chunk", cells.alias("_cell")).groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list("_cell")).alias("_rows"))

    # Windows of a chunk by number, in runs whose rows are bounded; the last ones may lack rows.
    run = max(CUT_ROWS // span, 1)
    whole = F.floor((F.size("_rows") - span) / apart).cast("int")
    runs = held.where(F.size("_rows") >= span).withColumn("_last", F.least(F.lit(per_chunk - 1), whole)).select("*", F.explode(F.sequence(F.lit(0), F.col("_last"), F.lit(run))).alias("_first"))

    def window(i: Column) -> Column:
        part = lambda skip, n: F.slice("_rows", i * apart + skip + 1, F.lit(n))
        start, end = F.element_at("_rows", i * apart + 1), F.element_at("_rows", i * apart + s.context)
        gap = F.array_max(F.transform(part(1, span - 1), lambda c: c["gap"])) if s.max_gap is not None and span > 1 else F.lit(None).cast("long")
        future = F.transform(part(s.context + s.shift, s.future), lambda c: F.struct(c["ts"].alias("ts"), c["_x"]["y"].alias("y"), c["w"].alias("w")))
        return F.struct(start["_r"].alias("window_id"), end["ts"].alias("context_end"), end["_x"]["y"].alias("end_value"), F.transform(part(0, s.context), lambda c: c["_x"]).alias("context"), future.alias("future"), gap.alias("_gap"))

    starts = F.sequence("_first", F.least(F.col("_first") + run - 1, F.col("_last")))
    if s.skip_null_target:
        starts = F.filter(starts, lambda i: F.element_at("_rows", i * apart + s.context + s.shift + 1)["_x"]["y"].isNotNull())
    found = runs.select(*keys, F.explode(F.transform(starts, window)).alias("_window")).select(*keys, "_window.*")
    if gap_limit is not None:
        # One row a series; series of one row have none.
        limited = join_on(found, gap_limit, keys, "left")
        found = limited.where(F.coalesce(F.col("_gap") <= F.col("step") * s.max_gap, F.lit(True)))
    return found.select(*keys, "window_id", "context_end", "end_value", "context", "future")


def require_windows(windows: DataFrame) -> DataFrame:
    """windows, or an error if there is none."""
    if windows.isEmpty():
        raise ValueError("no window is left: the series is too short, or all are dropped")
    return windows


def store(windows: DataFrame, out: str, lineage: dict[str, str] | None = None, keys: Sequence[str] = ("split",)) -> None:
    """out (Parquet by keys) and, beside it, <out>_manifest (JSON): shapes of each series' windows, and what they were made from."""
    windows.write.mode("overwrite").partitionBy(*keys).parquet(out)
    kept = windows.sparkSession.read.parquet(out)
    channels = len(windows.schema["context"].dataType.elementType.fields)
    shapes = kept.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.max(F.size("context")).alias("context"), F.max(F.size("future")).alias("future"), F.lit(channels).alias("channels"))
    shapes.select("*", *(F.lit(v).alias(k) for k, v in (lineage or {}).items())).coalesce(1).write.mode("overwrite").json(f"{out}_manifest")


def load(spark: SparkSession, out: str) -> DataFrame:
    """The windows that store() wrote."""
    return spark.read.parquet(out)


def arrays_of(windows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """windows as the arrays of window files: features alone (X_z) and with the target (X6_z), the first target (y_z_scalar) and all (Y_z), masks, weights and times.

    Names ignore case, so the single ones end in _scalar; files have them as y_z, y_mask and y_w.  Numbers are 32 bits wide, as those files have them.
    """
    names = windows.schema["context"].dataType.elementType.names
    number = lambda c: c.cast("float")
    cells = lambda cols, f: F.transform("context", lambda x: F.array(*(f(x[n]) for n in cols)))
    valid = lambda c: c.isNotNull()
    future = lambda f: F.transform("future", f)
    first = F.col("future")[0]
    return windows.select(
        *keys,
        cells(names[:-1], number).alias("X_z"), cells(names[:-1], valid).alias("X_mask"),
        cells(names, number).alias("X6_z"), cells(names, valid).alias("X6_mask"),
        number(first["y"]).alias("y_z_scalar"), valid(first["y"]).alias("y_mask_scalar"), number(first["w"]).alias("y_w_scalar"),
        future(lambda x: number(x["y"])).alias("Y_z"), future(lambda x: valid(x["y"])).alias("Y_mask"), future(lambda x: number(x["w"])).alias("Y_w"),
        number(F.col("end_value")).alias("chl_z_at_window_end"), F.col("context_end").alias("context_end_time"),
        first["ts"].alias("target_time"), future(lambda x: x["ts"]).alias("target_times"),
    )


def from_arrays(arrays: DataFrame, keys: Sequence[str] = ("npz_file",), window_id: str = "npz_row") -> DataFrame:
    """Windows from the arrays of window files; a value is there where its mask says so and it is finite.

    Files of one target each (y_z) give futures of one step, those without masks or weights take finiteness and 1.
    """
    have = set(arrays.columns)
    many = any(c in have for c in ("Y_z", "y_z_scalar"))
    column = lambda one, more, other: F.col(more if many else one) if (more if many else one) in have else other
    y = F.col("Y_z") if many else F.array("y_z")
    listed = lambda c: c if many else F.array(c)
    mask = listed(column("y_mask", "Y_mask", None)) if ("Y_mask" if many else "y_mask") in have else F.transform(y, lambda _: F.lit(True))
    weights = listed(column("y_w", "Y_w", None)) if ("Y_w" if many else "y_w") in have else F.transform(y, lambda _: F.lit(1.0).cast("float"))
    times = F.col("target_times") if many and "target_times" in have else F.transform(y, lambda _: F.col("target_time") if "target_time" in have else F.lit(None).cast("timestamp_ntz"))
    wide, wide_mask = ("X6_z", "X6_mask") if "X6_z" in have else ("X_z", "X_mask")
    seen = F.arrays_zip(F.col(wide).alias("x"), (F.col(wide_mask) if wide_mask in have else F.transform(wide, lambda r: F.transform(r, lambda _: F.lit(True)))).alias("m"))
    cell = lambda r, i: finite(F.when(F.get(r["m"], F.lit(i)), F.get(r["x"], F.lit(i)).cast("double")))
    channels = arrays.select(F.max(F.size(F.get(wide, F.lit(0))))).first()[0] or 0
    last = channels - 1 if wide == "X6_z" else channels
    target = lambda r: cell(r, last).alias("y") if wide == "X6_z" else F.lit(None).cast("double").alias("y")
    context = F.transform(seen, lambda r: F.struct(*(cell(r, i).alias(f"f{i}") for i in range(last)), target(r)))
    future = F.transform(F.arrays_zip(times.alias("ts"), y.alias("y"), mask.alias("m"), weights.alias("w")), lambda x: F.struct(x["ts"].alias("ts"), finite(F.when(x["m"], x["y"].cast("double"))).alias("y"), weight(x["w"].cast("double")).alias("w")))
    end = finite(F.col("chl_z_at_window_end").cast("double")) if "chl_z_at_window_end" in have else F.lit(None).cast("double")
    at = F.col("context_end_time") if "context_end_time" in have else F.lit(None).cast("timestamp_ntz")
    return arrays.select(*keys, F.col(window_id).alias("window_id"), at.alias("context_end"), end.alias("end_value"), context.alias("context"), future.alias("future"))


def long_form(windows: DataFrame, keys: Sequence[str] = ("split",)) -> DataFrame:
    """(keys, window_id, step, ts, y, valid, w, end_value): a row for each future step."""
    opened = windows.select(*keys, "window_id", "end_value", F.posexplode("future").alias("step", "_f"))
    return opened.select(*keys, "window_id", "step", F.col("_f.ts").alias("ts"), F.col("_f.y").alias("y"), F.col("_f.y").isNotNull().alias("valid"), F.col("_f.w").alias("w"), "end_value")


def window_summary(windows: DataFrame, n_channels: int, keys: Sequence[str] = ("split",)) -> DataFrame:
    """(keys, n_windows, context_valid, target_valid): the parts of cells with a value."""
    cells = F.flatten(F.transform("context", lambda x: F.array(*(x[f"f{i}"].isNotNull().cast("double") for i in range(n_channels)))))
    share = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)
    firsts = F.col("future")[0]["y"].isNotNull().cast("double")
    return windows.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.avg(share(cells)).alias("context_valid"), F.avg(firsts).alias("target_valid"))


def folded(c: Column, patch: int) -> Column:
    """An array cut into patches of that length; an array that patch does not divide fails."""
    n = F.size(c)
    cut = F.transform(F.sequence(F.lit(0), (n / patch).cast("int") - 1), lambda i: F.slice(c, i * patch + 1, F.lit(patch)))
    return F.when(n == 0, F.array().cast("array<array<double>>")).when(n % patch == 0, cut).otherwise(F.raise_error(F.lit(f"length is no multiple of {patch}")).cast("array<array<double>>"))


def patch_valid(c: Column) -> Column:
    """For each patch of folded(...), whether any of its values is there."""
    return F.transform(c, lambda p: F.exists(p, lambda x: x.isNotNull()))
