"""Following the audit log: live totals, per-model totals, request rate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.prune import reduction
from palimpsest.sources.audit_log import AUDIT_SCHEMA, with_defaults
from palimpsest.streaming.sinks import use_rocks_state


def follow_audit(spark: SparkSession, path: str, *, since: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """The audit log as a stream. Files land whole; progress is kept in the checkpoint.

    `since` skips files last changed before that time (a tail). Malformed lines come as rows without
    counts and are dropped with the rows whose counts are no numbers.
    """
    reader = spark.readStream.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED")
    if since is not None:
        reader = reader.option("modifiedAfter", since)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def live_totals(stream: DataFrame) -> DataFrame:
    """Session totals with the peak reduction."""
    return with_defaults(stream).groupBy().agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("tokens_before").alias("tokens_before"),
        F.sum("tokens_after").alias("tokens_after"),
        F.sum("blocks_purged").alias("blocks_purged"),
        F.greatest(F.max("reduction"), F.lit(0.0)).alias("peak_reduction"),
    )


def live_model_totals(stream: DataFrame) -> DataFrame:
    """Totals per model; the state is one row per model."""
    totals = with_defaults(stream).groupBy("model").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("tokens_before").alias("tokens_before"),
        F.sum("tokens_after").alias("tokens_after"),
    )
    return totals.withColumns(
        {
            "tokens_saved": F.col("tokens_before") - F.col("tokens_after"),
            "reduction": reduction(F.col("tokens_before"), F.col("tokens_after")),
        }
    )


def request_rate(stream: DataFrame, *, live_after: str | None = None, window: str = "60 seconds", slide: str = "5 seconds",
                 delay: str = "10 seconds") -> DataFrame:
    """Requests per sliding window. Rows up to `live_after` are replayed history and do not count.

    The watermark bounds the state: windows are emitted once no row can fall into them any more. A row without tokens is no
    request; it only moves the clock, so a finite log that ends with one closes all its windows (`closing_row`).
    """
    timed = stream.withColumn("at", F.to_timestamp("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    if live_after is not None:
        timed = timed.filter(F.col("at") > F.to_timestamp(F.lit(live_after)))
    counted = timed.withWatermark("at", delay).groupBy(F.window("at", window, slide)).agg(
        F.count("tokens_before").alias("requests")
    )
    return counted.filter("requests > 0").select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "requests"
    )


def closing_row(rows: DataFrame, seconds: int) -> DataFrame:
    """A row without tokens, `seconds` after the last of a log: what a gateway writes when it goes down."""
    last = F.max(F.to_timestamp("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    at = F.date_format(last + F.make_interval(secs=F.lit(seconds)), "yyyy-MM-dd'T'HH:mm:ss")
    return rows.agg(at.alias("ts")).filter("ts IS NOT NULL")


def recent_requests(stream: DataFrame, key: str = "deployment", *, span: int = 60, delay: str = "10 seconds") -> DataFrame:
    """`key`, `second`, `requests`: requests of the last `span` seconds at every second in which one came, that long ago included,
    exact, rows up to `delay` late included. Rows without tokens only move the clock.

    Requests are counted by second, and the counts meet in windows of two spans that begin with every span: the second half of a
    window has all it looks back to in the window. So a key is dealt by time, and a window has at most two counts per second of the
    span. A row comes when the watermark passes the end of its window, at most `span` seconds after its second."""
    use_rocks_state(stream.sparkSession)
    at = F.to_timestamp("ts", "yyyy-MM-dd'T'HH:mm:ss")
    timed = stream.withColumn("at", at).withWatermark("at", delay)
    # one condition that reads the time: others are pushed below the watermark, which then would not see clock rows
    request = F.when(F.col("at").isNotNull(), F.col("tokens_before").isNotNull()).otherwise(False)
    rows = timed.filter(request).select(F.col(key).cast("string").alias("key"), "at")
    seconds = rows.groupBy("key", F.window("at", "1 second")).agg(F.count(F.lit(1)).alias("n"))
    counts = seconds.select("key", F.window_time("window").alias("at"), F.unix_seconds("window.start").alias("second"), "n")
    spans = counts.groupBy("key", F.window("at", f"{2 * span} seconds", f"{span} seconds")).agg(F.collect_list(F.struct("second", "n")).alias("counts"))
    each = spans.select("key", F.explode("counts.second").alias("second"), "counts", F.unix_seconds("window.start").alias("start"))
    back = F.filter("counts", lambda c: c["second"].between(F.col("second") - span, F.col("second")))
    total = F.aggregate(back, F.lit(0).cast("bigint"), lambda n, c: n + c["n"])
    return each.filter(F.col("second") >= F.col("start") + span).select(F.col("key").alias(key), "second", total.alias("requests"))
