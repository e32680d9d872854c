"""Running streams to the end of what is available, and tables as sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators.lineage import checkpoint_root

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def use_rocks_state(spark: SparkSession) -> None:
    """Keyed state with lists needs the disk-backed state store."""
    if spark.conf.get(STATE_STORE, "") != ROCKS:
        spark.conf.set(STATE_STORE, ROCKS)


def append_to_table(stream: DataFrame, label: str, *, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything available into a Parquet folder and read it back."""
    spark = stream.sparkSession
    root = scratch(spark, label)
    target, progress = path or f"{root}/rows", checkpoint or f"{root}/progress"
    query = (
        stream.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", progress)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def latest_to_table(stream: DataFrame, label: str, *, mode: str = "complete") -> DataFrame:
    """Process everything available; every batch replaces the table with the current totals."""
    spark = stream.sparkSession
    root = scratch(spark, label)

    last: list[int] = []

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/{number}")
        last[:] = [number]

    query = (
        stream.writeStream.foreachBatch(replace)
        .option("checkpointLocation", f"{root}/progress")
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows/{last[0]}") if last else spark.createDataFrame([], stream.schema)
