"""Appending to hash chains as audit rows arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.operators import ledger as L
from palimpsest.streaming.sinks import scratch

CHAIN_SCHEMA = (
    "deployment STRING, segment BIGINT, seq BIGINT, ts STRING, model STRING, tokens_before BIGINT, "
    "tokens_after BIGINT, source_seq BIGINT, prev_hash STRING, hash STRING"
)


def stored_chain(spark: SparkSession, path: str) -> DataFrame:
    """The chained rows: `seq` is a row's place in its chain, `source_seq` the number it came with."""
    return spark.read.schema(f"{CHAIN_SCHEMA}, batch BIGINT").parquet(path)


def append_batch(batch: DataFrame, ends: DataFrame | None, keys: Sequence[str] = ("deployment",)) -> DataFrame:
    """Chain rows of a batch in the order of arrival, after the stored ends (`_end`, `resume` per key).

    Rows of a batch arrive together; they take the next places of their chain in the order of their own numbers. A row that
    comes late takes the place at which it arrives, so every row is in the chain and no stored row changes.
    """
    if ends is None:
        ends = batch.select(*keys).limit(0).withColumns({"_end": F.lit(None).cast("bigint"), "resume": F.lit(None).cast("string")})
    renamed = {c: f"_{c}" for c in keys}
    ends = ends.withColumnsRenamed(renamed)
    placed = batch.join(ends, [batch[c].eqNullSafe(ends[n]) for c, n in renamed.items()], "left").drop(*renamed.values())
    arrival = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("seq"), "ts", "model", "tokens_before", "tokens_after")
    numbered = placed.withColumns({"source_seq": F.col("seq"), "place": F.coalesce("_end", F.lit(0)) + F.row_number().over(arrival)})
    rows = numbered.drop("seq", "_end").withColumn("seq", F.col("place").cast("bigint")).drop("place")
    return L.chain(rows, keys, also=["source_seq"])


def _ends(chained: DataFrame, earlier: DataFrame | None, keys: Sequence[str] = ("deployment",)) -> DataFrame:
    """Last place and hash of every chain: one row per key, from the last ends and the new rows."""
    new = chained.select(*keys, F.col("seq").alias("_end"), F.col("hash").alias("resume"))
    rows = new if earlier is None else new.unionByName(earlier.select(*keys, "_end", "resume"))
    return rows.groupBy(*keys).agg(F.max("_end").alias("_end"), F.max_by("resume", "_end").alias("resume"))


def chain_stream(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available. Each batch writes its own folders, so a repeated batch replaces them, and reads only the
    table of chain ends that the batch before left."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        ends = spark.read.parquet(f"{path}-ends/batch={number - 1}") if number > 0 else None
        append_batch(batch, ends).write.mode("overwrite").parquet(f"{path}/batch={number}")
        done = spark.read.schema(CHAIN_SCHEMA).parquet(f"{path}/batch={number}")
        _ends(done, ends).write.mode("overwrite").parquet(f"{path}-ends/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def chained_table(stream: DataFrame) -> DataFrame:
    spark = stream.sparkSession
    root = scratch(spark, "chain")
    chain_stream(stream, f"{root}/rows", f"{root}/progress")
    return stored_chain(spark, f"{root}/rows")
