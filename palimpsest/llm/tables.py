"""Small helpers of the operators in this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an id list that may be broadcast: 16 MB of ids. Larger lists are joined by shuffle.
BROADCAST_IDS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def counted_hint(ids: DataFrame, rows: int) -> DataFrame:
    """`ids` to be broadcast if the counted rows are within the bound, else as it is."""
    return F.broadcast(ids) if rows <= BROADCAST_IDS else ids
