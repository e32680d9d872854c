"""Energy, carbon and money columns with low, mid and high bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.dims import KWH_PER_MTOK, grid_factor

BOUNDS = ("low", "mid", "high")


def uncached_share(hit: float, cost: float = 0.10) -> float:
    """Share of a saving that counts if tokens would have been read from a cache with probability `hit`, at `cost` times the price."""
    for name, value in (("hit", hit), ("cost", cost)):
        if not 0.0 <= value <= 1.0:
            raise ValueError(f"cache {name} must lie between 0 and 1, not {value}")
    return 1.0 - hit * (1.0 - cost)


def watt_hours(tokens: Column, bound: str, multiplier: float = 1.0) -> Column:
    return tokens / 1e6 * KWH_PER_MTOK[bound] * 1000.0 * multiplier


def bounded(tokens: Column, multiplier: float = 1.0) -> Column:
    return F.struct(*[watt_hours(tokens, b, multiplier).alias(b) for b in BOUNDS])


def saved_columns(tokens: Column, grid: str = "world", cache_hit: float = 0.0, cache_cost: float = 0.10) -> dict[str, Column]:
    """wh_low ... gco2e_high of a token saving; zero when nothing was saved."""
    factor = grid_factor(grid)
    multiplier = uncached_share(cache_hit, cache_cost)
    saved = F.greatest(tokens, F.lit(0))
    out = {f"wh_{b}": watt_hours(saved, b, multiplier) for b in BOUNDS}
    return out | {f"gco2e_{b}": watt_hours(saved, b, multiplier) / 1000.0 * factor for b in BOUNDS}
