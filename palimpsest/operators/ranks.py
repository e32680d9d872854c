"""Ranks inside groups of any size, on two levels.

Distinct values are dealt to ranges of all groups together. A range knows how many rows of its group lie in lower ranges from a
list with one entry per range; inside it a window over its own values does the rest. A group that holds most rows covers many
ranges, and no task sees more than one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.lineage import cut


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], names: Mapping[str, str]) -> list[Column]:
    """Equality of keys, null like any value; `names` gives the right side's names."""
    return [left[k].eqNullSafe(right[names.get(k, k)]) for k in keys]


@dataclass(frozen=True)
class Ranks:
    """`rows`: per group and distinct value `ties` (rows of it), `below` (rows of smaller values) and what was asked for besides.
    `parts`: per group and range the rows before it (`carry`) and in it (`total`)."""

    by: list[str]
    value: str
    rows: DataFrame
    parts: DataFrame

    def sizes(self) -> DataFrame:
        """Rows of each group: `n`."""
        return self.parts.groupBy(*self.by).agg(F.sum("total").alias("n"))

    def at(self, wanted: DataFrame) -> DataFrame:
        """`wanted` (group, `name`, `rank` from 1) with the value of that rank."""
        renamed = {c: f"_{c}" for c in self.by}
        parts = self.parts.withColumnsRenamed(renamed).withColumnRenamed("part", "_part")
        inside = (F.col("carry") < F.col("rank")) & (F.col("rank") <= F.col("carry") + F.col("total"))
        found = wanted.join(parts, same_keys(wanted, parts, self.by, renamed)).filter(inside).select(*renamed.values(), "_part", "name", "rank")
        names = renamed | {"part": "_part"}
        hit = self.rows.join(found, same_keys(self.rows, found, [*self.by, "part"], names))
        hit = hit.filter((F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("ties")))
        return hit.select(*self.by, "name", "rank", self.value)


def ranks(values: DataFrame, by: Sequence[str], value: str, also: Mapping[str, Column] | None = None) -> Ranks:
    """Ranks of `value` in each group, nulls left out; `also` holds further aggregates of the rows that share a value."""
    by = list(by)
    more = [c.alias(name) for name, c in (also or {}).items()]
    counts = values.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"), *more)
    dealt = cut(counts.repartitionByRange(*by, value).withColumn("part", F.spark_partition_id()))
    listed = dealt.groupBy(*by, "part").agg(F.sum("ties").alias("total")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("part", "total"))).alias("l"))
    before = F.transform(
        "l", lambda e, i: F.struct(e["part"].alias("part"), F.aggregate(F.slice("l", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["total"]).alias("carry"), e["total"].alias("total"))
    )
    parts = cut(listed.select(*by, F.explode(before).alias("p")).select(*by, "p.*"))
    names = {c: f"_{c}" for c in [*by, "part"]}
    carries = parts.drop("total").withColumnsRenamed(names)
    placed = dealt.join(carries, same_keys(dealt, carries, [*by, "part"], names)).drop(*names.values())
    inside = Window.partitionBy(*by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("carry") + F.coalesce(F.sum("ties").over(inside), F.lit(0))
    return Ranks(by, value, placed.withColumn("below", below).drop("carry"), parts)
