"""Registry of query name -> (DataFrame builder, SQL text)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under `name`; without SQL only its rows can be checked."""

    def register(builder: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = builder
        if sql is not None:
            ORACLES[name] = sql.strip()
        return builder

    return register
