"""Column functions and small helpers on settings.  NULL is the one missing value: NaN and infinities become NULL."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "d": 86_400_000_000}
DAY_MICROS = _UNITS["d"]
DEFAULT_FREQ = "30min"


def quoted(name: str) -> Column:
    """A column whose name may hold dots, slashes or signs."""
    return F.col("`" + name.replace("`", "``") + "`")


def parse_time(c: Column) -> Column:
    """timestamp_ntz, NULL where the text is no time."""
    return c.try_cast("timestamp_ntz")


def finite(c: Column) -> Column:
    """c, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def to_number(c: Column) -> Column:
    """double, NULL where the text is no finite number."""
    return finite(c.try_cast("double"))


def flag(c: Column) -> Column:
    """A quality flag without blanks; empty is NULL."""
    return F.nullif(F.trim(c), F.lit(""))


def flagged(c: Column, codes: Sequence[str]) -> Column:
    """Whether the flag is one of codes; NULL is not."""
    return F.coalesce(flag(c).isin(*codes), F.lit(False)) if codes else F.lit(False)


def clip(c: Column, low, high) -> Column:
    """c within [low, high]; NULL stays NULL (least and greatest alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def weight(c: Column) -> Column:
    """A weight within [0, 1]; what is no finite number weighs nothing."""
    return F.least(F.greatest(F.coalesce(finite(c), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def weight_of(bad: Column) -> Column:
    """1 where not flagged, 0 where flagged."""
    return (~F.coalesce(bad, F.lit(False))).cast("double")


def standardise(c: Column, mean: Column, std: Column) -> Column:
    return (c - mean) / std


def restore(c: Column, mean: Column, std: Column) -> Column:
    return c * std + mean


def json_safe(c: Column) -> Column:
    """finite values alone, so that to_json writes null and no NaN."""
    return finite(c)


def _label(v: float | None) -> str:
    return "" if v is None else f"{v:.1e}" if abs(v) < 0.01 and v else f"{v:.2f}"


def annotation(c: Column) -> Column:
    """Heat map label: nothing where missing, %.1e for small values, else %.2f.

    Formatted in Python, which rounds the binary value as C does; Java's format_string
    rounds its shortest decimal, halves up (2.9e-04 of 0.000285, which is less than that).
    """
    labels = F.arrow_udf(lambda values: pa.array([_label(v) for v in values.to_pylist()], pa.string()), "string")
    return labels(finite(c.cast("double")))


def renamed(c: Column, names: Mapping[str, str]) -> Column:
    """c with the values that names has replaced."""
    out = c
    for old, new in names.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return out


def slug(c: Column) -> Column:
    """Letters and digits, runs of all else as one underscore; empty is 'custom'."""
    words = F.trim(F.regexp_replace(c, "[^0-9a-zA-Z]+", " "))
    return F.coalesce(F.nullif(F.translate(words, " ", "_"), F.lit("")), F.lit("custom"))


def slug_of(text: str) -> str:
    return re.sub(r"[^0-9a-zA-Z]+", "_", text).strip("_") or "custom"


def freq_micros(freq: str) -> int:
    """Microseconds of a fixed length such as 30min, 10s or 7h.  Months and other lengths that vary are refused."""
    m = re.fullmatch(r"\s*(\d*)\s*(ms|s|min|h|d)\s*", freq, re.IGNORECASE)
    if not m or m[1] and not int(m[1]):
        raise ValueError(f"not a fixed positive length of time: {freq!r}")
    return int(m[1] or 1) * _UNITS[m[2].lower()]


def resolve_freq(given: str | None = None, variable: str = "WEIRFLOW_FREQ") -> str:
    """given, else the environment's, else 30min; checked."""
    freq = given or os.environ.get(variable) or DEFAULT_FREQ
    freq_micros(freq)
    return freq


def hampel_rows(hours: float, freq: str) -> int:
    """An odd number of rows that covers so many hours, 7 at least."""
    return max(7, round(hours * 3_600_000_000 / freq_micros(freq)) | 1)


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp_ntz, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ts)


def from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01").cast("timestamp_ntz"))
