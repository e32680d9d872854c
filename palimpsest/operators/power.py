"""Energy of intervals from power samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.sequence import Layout


def samples_in_intervals(samples: DataFrame, intervals: DataFrame, *, bucket_us: int = 86_400_000_000) -> DataFrame:
    """Samples joined to the closed intervals [t0, t1] of their device that hold them.

    Both sides are cut into time buckets, which makes the range join an equi-join on (device, bucket)
    with a range filter; a hot device is spread over its buckets. Times are in microseconds.
    """
    cut = intervals.withColumn(
        "_bucket", F.explode(F.sequence(F.floor(F.col("t0") / bucket_us), F.floor(F.col("t1") / bucket_us)))
    )
    placed = samples.withColumn("_bucket", F.floor(F.col("t") / bucket_us))
    inside = (F.col("t") >= F.col("t0")) & (F.col("t") <= F.col("t1"))
    return placed.join(cut, ["device", "_bucket"]).filter(inside).drop("_bucket")


def interval_energy(samples: DataFrame, intervals: DataFrame, *, bucket_us: int = 86_400_000_000) -> DataFrame:
    """Trapezoid energy per interval in joule, minus the idle draw, not below 0.

    Input: samples (device, t, watts), intervals (device, interval_id, t0, t1, idle_w). Fewer than two
    samples give 0. Neighbouring samples may lie in different buckets; the first sample of the next
    bucket is carried over, so long intervals are not gathered in one task.
    """
    joined = samples_in_intervals(samples, intervals, bucket_us=bucket_us)
    layout = Layout(["device", "interval_id"], "t", bucket_us)
    point = F.struct("t", "watts")
    rows = layout.carry(layout.split(joined), first_after={"_later": point})
    following = layout.following_first(point, F.col("_later"))
    step = rows.withColumn("_next", following)
    seconds = (F.col("_next.t") - F.col("t")) / 1e6
    area = (F.col("watts") + F.col("_next.watts")) / 2.0 * seconds
    sums = step.groupBy("device", "interval_id").agg(
        F.coalesce(F.sum(area), F.lit(0.0)).alias("_joule"),
        ((F.max("t") - F.min("t")) / 1e6).alias("_seconds"),
        F.max("idle_w").alias("_idle"),
        F.count(F.lit(1)).alias("samples"),
    )
    found = intervals.select("device", "interval_id").join(sums, ["device", "interval_id"], "left")
    enough = F.coalesce(F.col("samples"), F.lit(0)) >= 2
    net = F.greatest(F.col("_joule") - F.col("_idle") * F.col("_seconds"), F.lit(0.0))
    return found.select(
        "device",
        "interval_id",
        F.when(enough, F.col("_joule")).otherwise(0.0).alias("joule"),
        F.when(enough, net).otherwise(0.0).alias("marginal_joule"),
        F.when(enough & (F.col("_seconds") > 0), F.col("_joule") / F.col("_seconds")).otherwise(0.0).alias("avg_watts"),
        F.coalesce(F.col("samples"), F.lit(0)).alias("samples"),
    )
