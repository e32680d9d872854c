"""The request audit log: JSON lines in, JSON lines or Parquet out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIT_SCHEMA = (
    "seq BIGINT, deployment STRING, ts STRING, model STRING, stream BOOLEAN, tokens_before BIGINT, "
    "tokens_after BIGINT, reduction DOUBLE, kernel_latency_us DOUBLE, blocks_purged BIGINT, held BOOLEAN, "
    "potential_reduction DOUBLE, effort STRUCT<tier: STRING, score: DOUBLE, action: STRING>, "
    "purged_hashes ARRAY<STRING>"
)


def read_audit(spark: SparkSession, path: str, *, sized_only: bool = False) -> DataFrame:
    """Rows of the log without blank and malformed lines.

    A line whose fields have other types (tokens that are not numbers) is dropped as malformed. With
    `sized_only`, rows that carry no token count are dropped too.
    """
    rows = spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return rows.filter(F.col("tokens_before").isNotNull()) if sized_only else rows


def with_defaults(rows: DataFrame) -> DataFrame:
    """Missing counts are 0, a missing model is "?"."""
    return rows.withColumns(
        {
            "tokens_before": F.coalesce("tokens_before", F.lit(0)),
            "tokens_after": F.coalesce("tokens_after", F.lit(0)),
            "blocks_purged": F.coalesce("blocks_purged", F.lit(0)),
            "reduction": F.coalesce("reduction", F.lit(0.0)),
            "kernel_latency_us": F.coalesce("kernel_latency_us", F.lit(0.0)),
            "model": F.coalesce("model", F.lit("?")),
        }
    )


def audit_rows(requests: DataFrame, *, ts: Column, model: Column, stream: Column | None = None,
               latency: Column | None = None) -> DataFrame:
    """Request audits in the shape and rounding of the log; optional fields stay null."""

    def optional(name: str, kind: str) -> Column:
        return (F.col(name) if name in requests.columns else F.lit(None)).cast(kind)

    held = F.when(optional("held", "boolean"), True)
    return requests.select(
        optional("seq", "bigint").alias("seq"),
        optional("deployment", "string").alias("deployment"),
        ts.alias("ts"),
        F.coalesce(model, F.lit("?")).alias("model"),
        F.coalesce(stream if stream is not None else F.lit(False), F.lit(False)).alias("stream"),
        F.col("tokens_before").cast("bigint").alias("tokens_before"),
        F.col("tokens_after").cast("bigint").alias("tokens_after"),
        F.bround("reduction", 4).alias("reduction"),
        F.bround(latency if latency is not None else F.lit(0.0), 2).alias("kernel_latency_us"),
        F.col("blocks_purged").cast("bigint").alias("blocks_purged"),
        held.alias("held"),
        F.when(held, optional("potential_reduction", "double")).alias("potential_reduction"),
        optional("effort", "struct<tier: string, score: double, action: string>").alias("effort"),
        F.when(F.size(optional("purged_hashes", "array<string>")) > 0, optional("purged_hashes", "array<string>"))
        .alias("purged_hashes"),
    )


def write_audit(rows: DataFrame, path: str, *, format: str = "json", partition_by_day: bool = True) -> None:
    """Append to the log; partitioned by day and model, so reports read only their slice."""
    out, parts = rows, []
    if partition_by_day:
        out = rows.withColumns({"day": F.substring("ts", 1, 10), "model_key": F.col("model")})
        parts = ["day", "model_key"]
    out.write.mode("append").partitionBy(*parts).format(format).save(path)
