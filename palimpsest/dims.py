"""Small fixed dimensions as DataFrames: model prices, energy coefficients, grids.

All of them have a handful of rows, set here or by the caller, so broadcasting them is safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# List prices in USD per million tokens.
ROSTER = [
    ("fable-5", "frontier", 10.00, 50.00),
    ("gpt-5.6-sol", "frontier", 5.00, 30.00),
    ("claude-opus", "frontier", 5.00, 25.00),
    ("gpt-5.5", "frontier", 5.00, 30.00),
    ("gemini-pro", "frontier", 2.00, 12.00),
    ("claude-haiku", "budget", 1.00, 5.00),
    ("gpt-mini", "budget", 0.75, 4.50),
    ("deepseek-chat", "budget", 0.14, 0.28),
]
ROSTER_SCHEMA = "model STRING, tier STRING, price_in DOUBLE, price_out DOUBLE"

# Price of a call to a model without a list price.
FALLBACK_PRICE_IN = 1.0
FALLBACK_PRICE_OUT = 3.0

# kWh per million tokens and g CO2e per kWh.
KWH_PER_MTOK = {"low": 0.5, "mid": 0.9, "high": 1.3}
GRID_G_PER_KWH = {"world": 445.0, "eu": 230.0, "us": 385.0, "br": 100.0}
COEFFICIENT_VERSION = "esg-1.0"

BROADCAST_ROWS = 10_000


def roster(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(ROSTER if rows is None else rows, ROSTER_SCHEMA)


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Price table from a JSON document {tier: {model: {price_in, price_out, ...}}}."""
    price = "struct<price_in: double, price_out: double>"
    document = spark.read.text(path, wholetext=True)
    tiers = document.select(
        F.explode(F.from_json("value", f"map<string, map<string, {price}>>")).alias("tier", "models")
    )
    return tiers.select("tier", F.explode("models").alias("model", "price")).select(
        "model", "tier", "price.price_in", "price.price_out"
    )


def coefficients(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KWH_PER_MTOK.items()), "bound STRING, kwh_per_mtok DOUBLE")


def grids(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GRID_G_PER_KWH.items()), "grid STRING, g_per_kwh DOUBLE")


def grid_factor(grid: str) -> float:
    if grid not in GRID_G_PER_KWH:
        raise ValueError(f"unknown grid {grid!r}; known: {sorted(GRID_G_PER_KWH)}")
    return GRID_G_PER_KWH[grid]


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a caller's dimension only if it has at most `limit` rows; larger ones join by shuffle."""
    return F.broadcast(df) if len(df.limit(limit + 1).take(limit + 1)) <= limit else df
