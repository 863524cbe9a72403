"""Quality control by flags: whole rows or single cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions.scalars import finite, flagged, quoted

# The flags of excluded measurements.
EXCLUDED = ("B7", "C", "M")


def drop_flagged(df: DataFrame, flag_col: str, codes: Sequence[str] = EXCLUDED) -> DataFrame:
    """Rows whose flag is not excluded; rows without a flag stay."""
    return df.where(~flagged(quoted(flag_col), codes))


def mask_flagged(df: DataFrame, flags: Mapping[str, str], codes: Sequence[str] = EXCLUDED) -> DataFrame:
    """Values of excluded flags become NULL, rows stay.  flags: value column to flag column; an absent flag column flags nothing."""
    present = set(df.columns)
    masked = {v: F.when(~flagged(quoted(f), codes), finite(quoted(v))) if f in present else finite(quoted(v)) for v, f in flags.items()}
    return df.withColumns(masked)
