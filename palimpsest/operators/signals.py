"""Signal channels: additive concentrations per flag bit, decay per tick, bounded retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CHANNELS = 32


def _width(channels: int) -> int:
    return min(max(int(channels), 1), MAX_CHANNELS)


def channel_events(events: DataFrame, channels: int = MAX_CHANNELS) -> DataFrame:
    """One row per event and set bit below `channels`; higher bits are ignored."""
    bits = F.sequence(F.lit(0), F.lit(_width(channels) - 1))
    flags = F.col("flags").cast("bigint")
    return events.withColumn("channel", F.explode(F.filter(bits, lambda b: F.getbit(flags, b) == 1)))


def concentrations(events: DataFrame, by: Sequence[str] = (), channels: int = MAX_CHANNELS) -> DataFrame:
    """Sum of intensities per channel."""
    return channel_events(events, channels).groupBy(*by, "channel").agg(F.sum("intensity").alias("concentration"))


def bus_stats(events: DataFrame, by: Sequence[str] = (), channels: int = MAX_CHANNELS) -> DataFrame:
    """Secretions (one per event, whatever its bits) and total concentration."""
    width = _width(channels)
    set_bits = F.bit_count(F.col("flags").cast("bigint").bitwiseAND(F.lit((1 << width) - 1)))
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("secretions"), F.sum(F.col("intensity") * set_bits).alias("total_concentration")
    )


def snapshot(levels: DataFrame, by: Sequence[str] = (), channels: int = MAX_CHANNELS) -> DataFrame:
    """All channel levels of a bus in one row, 0 where nothing was added; at most 32 values."""
    entry = F.map_from_entries(F.collect_list(F.struct("channel", "concentration")))
    numbers = F.sequence(F.lit(0), F.lit(_width(channels) - 1))
    known = levels.groupBy(*by).agg(entry.alias("_m"))
    return known.select(
        *by, F.transform(numbers, lambda c: F.coalesce(F.try_element_at("_m", c), F.lit(0.0))).alias("levels")
    )


def sense(levels: DataFrame, masks: Mapping[str, int], by: Sequence[str] = ()) -> DataFrame:
    """Level per named mask: sum over its channels."""
    named = F.array(
        *[F.struct(F.lit(n).alias("mask_id"), F.lit(m).cast("bigint").alias("mask")) for n, m in masks.items()]
    )
    each = levels.withColumn("_m", F.explode(named))
    hit = F.getbit(F.col("_m.mask"), F.col("channel")) == 1
    return each.groupBy(*by, F.col("_m.mask_id").alias("mask_id")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("concentration"))), F.lit(0.0)).alias("level")
    )


def dissipated(events: DataFrame, tick: Column, until: int | Column, decay: float, by: Sequence[str] = (),
               channels: int = MAX_CHANNELS) -> DataFrame:
    """Levels when every tick multiplies all channels by `decay`.

    `tick` counts the ticks before an event, `until` all ticks; an event has faded by the ticks in
    between, so the state is one sum and needs no ordered pass.
    """
    total = F.lit(until) if isinstance(until, int) else until
    faded = F.col("intensity") * F.pow(F.lit(float(decay)), total - tick)
    return concentrations(events.withColumn("intensity", faded), by, channels)


def retained(events: DataFrame, interval: Sequence[str], order: Sequence[str], capacity: int) -> DataFrame:
    """First `capacity` events of each drain interval; later ones are dropped while the buffer is full.

    The rank filter is applied within each task before the shuffle (window group limit), so a hot
    interval sends `capacity` rows per task.
    """
    w = Window.partitionBy(*interval).orderBy(*order)
    return events.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= capacity).drop("_rank")
