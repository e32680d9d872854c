"""Alerts and signal channels on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import repetition_score
from palimpsest.operators import scans, signals


def alert_stream(texts: DataFrame, *, threshold: float = scans.ALERT_THRESHOLD) -> DataFrame:
    """Signal events of the flooding texts of a stream; each row is decided on its own."""
    scored = texts.withColumn("score", repetition_score(F.col("text")))
    return scans.alert_events(scored.withColumn("alert", F.col("score") >= threshold))


def channel_stream(events: DataFrame, channels: int = signals.MAX_CHANNELS) -> DataFrame:
    """Running level per channel; at most 32 rows of state."""
    return signals.concentrations(events, channels=channels)


def tick_sums(events: DataFrame, time: str, tick: str, *, delay: str, channels: int = signals.MAX_CHANNELS) -> DataFrame:
    """Intensity added per channel within each tick of a stream.

    Decay between ticks is a power of the number of ticks, so levels follow from these sums
    (`levels_after`) and no level has to be kept as state.
    """
    hit = signals.channel_events(events.withWatermark(time, delay), channels)
    return (
        hit.groupBy(F.window(time, tick), "channel")
        .agg(F.sum("intensity").alias("added"))
        .select(F.col("window.start").alias("tick_start"), "channel", "added")
    )


def levels_after(sums: DataFrame, ticks_since: Column, decay: float) -> DataFrame:
    """Channel levels from tick sums; `ticks_since` counts the ticks that have passed since each."""
    return sums.groupBy("channel").agg(
        F.sum(F.col("added") * F.pow(F.lit(float(decay)), ticks_since)).alias("concentration")
    )
