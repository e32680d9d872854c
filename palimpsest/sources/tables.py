"""The given tables, read as the shapes the operators expect."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import config as C
from palimpsest.config import PruneConfig
from palimpsest.functions import text as T
from palimpsest.operators.sequence import dense_positions, fitting_block_rows

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Sessions:
    """Session rows and the block size they need: 0 when every session was counted to fit one task."""

    rows: DataFrame
    block_rows: int

    def config(self, cfg: PruneConfig = PruneConfig()) -> PruneConfig:
        return cfg.with_(block_rows=self.block_rows)

    def with_rows(self, rows: DataFrame) -> "Sessions":
        return Sessions(rows, self.block_rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_sizes(df: DataFrame) -> DataFrame:
    """Token sizes of `text`. Taken at the scan, so that jobs which need no text do not shuffle it."""
    return df.withColumns(
        {"tokens": T.token_size(F.col("text")), "frozen_tokens": T.char_quarter(F.col("text"))}
    )


def balanced(df: DataFrame) -> DataFrame:
    """Spread a table of few input splits over all cores, for work that costs far more than its shuffle.

    Tables with at least one split per core, such as any large one, are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def conversations(spark: SparkSession, sf_dir: str, block_rows: int | None = None) -> Sessions:
    """One session per conversation; turns are dense positions."""
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", "text"
    )
    return Sessions(rows, fitting_block_rows(rows, "session_id") if block_rows is None else block_rows)


def long_sessions(spark: SparkSession, sf_dir: str, tracks: int = 10, block_rows: int | None = None) -> Sessions:
    """Conversations chained into few long sessions, in (conversation, turn) order."""
    rows = with_sizes(table(spark, sf_dir, "conversations").withColumn("session_id", F.col("conv_id") % tracks))
    if block_rows is None:
        block_rows = fitting_block_rows(rows, "session_id")
    numbered = dense_positions(
        rows,
        ["session_id"],
        ["conv_id", "turn"],
        fine={"conv": F.col("conv_id"), "turns": F.floor(F.col("turn") / C.BLOCK_ROWS)},
        coarse=F.floor(F.col("conv_id") / (tracks * 4096)),
        whole=block_rows == 0,
    )
    return Sessions(numbered.select("session_id", "pos", "n", "conv_id", "turn", "role", "tokens", "frozen_tokens", "text"), block_rows)


def event_sessions(
    spark: SparkSession, sf_dir: str, block_rows: int | None = None, prepare: Step | None = None
) -> Sessions:
    """Events of a user as an agent session: calls, tool output, thinking, user turns, facts.

    `prepare` adds columns that depend on single rows; it runs before the rows are numbered.
    """
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        "event_type",
        "value",
        F.when(kind == "error", "tool")
        .when(kind.isin("click", "view"), "assistant")
        .when(kind == "signup", "system")
        .otherwise("user")
        .alias("role"),
        (kind == "click").alias("has_calls"),
        F.when(kind == "error", C.TOOL)
        .when(kind == "view", C.THINKING)
        .when(kind == "click", C.ASSISTANT)
        .when(kind == "signup", C.FACT)
        .otherwise(C.USER)
        .alias("signal"),
        F.col("props").alias("text"),
    )
    if block_rows is None:
        block_rows = fitting_block_rows(rows, "session_id")
    numbered = dense_positions(
        rows if prepare is None else prepare(rows),
        ["session_id"],
        ["ts", "event_id"],
        fine={"hour": F.floor(F.unix_seconds("ts") / 3600)},
        coarse=F.floor(F.unix_seconds("ts") / (3600 * 24 * 32)),
        whole=block_rows == 0,
    )
    return Sessions(numbered, block_rows)
