"""Dashboard quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncated_percent(value: Column) -> Column:
    """One decimal, cut and not rounded."""
    return (value * 1000).cast("bigint") / 10


def level(value: Column, levels: int = 8) -> Column:
    """Bucket 0 .. levels - 1 of a value clamped to 0 .. 1."""
    clamped = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
    return F.least(F.floor(clamped * levels).cast("bigint"), F.lit(levels - 1).cast("bigint"))
