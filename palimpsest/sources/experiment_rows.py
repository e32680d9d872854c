"""Experiment result rows: JSON lines, or summary documents that embed the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as PT

RESULT_SCHEMA = (
    "ingest_seq BIGINT, task STRING, lang STRING, stale_ratio STRING, model STRING, tier STRING, arm STRING, "
    "rep INT, mock BOOLEAN, input_tokens BIGINT, output_tokens BIGINT, cost_usd DOUBLE, latency_s DOUBLE, "
    "success BOOLEAN, refusal STRING, finish_reason STRING, error STRING"
)


def valid_rows(rows: DataFrame, *, drop_mock: bool = True) -> DataFrame:
    """Without error rows and, on request, mock rows; a missing rep is 0."""
    out = rows.filter(F.col("error").isNull()).withColumn("rep", F.coalesce("rep", F.lit(0)))
    return out.filter(~F.coalesce(F.col("mock"), F.lit(False))) if drop_mock else out


def read_results(spark: SparkSession, path: str, *, drop_mock: bool = True) -> DataFrame:
    """One JSON object per line; blank and malformed lines are skipped."""
    rows = spark.read.schema(RESULT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return valid_rows(rows, drop_mock=drop_mock)


def read_summary(spark: SparkSession, path: str, *, drop_mock: bool = True, wholetext: bool = True) -> DataFrame:
    """JSON documents that are a list of rows, or hold one under rows, results or raw.

    A document is a file, or with `wholetext` off a line.
    """
    row = PT.StructType.fromDDL(RESULT_SCHEMA)
    listed = PT.ArrayType(row)
    named = PT.StructType([PT.StructField(n, listed) for n in ("rows", "results", "raw")])
    text = spark.read.text(path, wholetext=wholetext)
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    inside = F.from_json("value", named)

    def filled(name: str):
        return F.when(F.size(inside[name]) > 0, inside[name])

    chosen = F.when(is_list, F.from_json("value", listed)).otherwise(
        F.coalesce(filled("rows"), filled("results"), filled("raw"))
    )
    rows = text.select(F.explode(chosen).alias("r")).select("r.*")
    return valid_rows(rows, drop_mock=drop_mock)
