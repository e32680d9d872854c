"""Exact medians of groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.lineage import cut

#: Ranks between which a median is looked for, and the accuracy of the sketch that finds them: its error, one hundred
#: thousandth of a group, is far inside.
BRACKET = (0.499, 0.501)
ACCURACY = 100_000


def exact_medians(df: DataFrame, by: Sequence[str], values: Mapping[str, Column], *, also: Sequence[Column] = ()) -> DataFrame:
    """Interpolated medians per group, next to the aggregates in `also`; null where a group has no value.

    Two passes for all measures together, the same for groups of every size. The first sketches a bracket around each median.
    The second counts the rows below it and the rows of each value inside, and the two middle ranks are found among those: a
    window over the distinct values of one five-hundredth of a group. No task gathers the values of a group.
    """
    by = list(by)
    names = list(values)
    wide = df.select(*df.columns, *[v.cast("double").alias(f"_v{k}") for k, v in enumerate(values.values())])
    brackets = cut(
        wide.groupBy(*by).agg(
            *also,
            *[F.percentile_approx(f"_v{k}", list(BRACKET), ACCURACY).alias(f"_q{k}") for k in range(len(names))],
            *[F.count(f"_v{k}").alias(f"_n{k}") for k in range(len(names))],
        )
    )
    keys = [f"_key{i}" for i in range(len(by))]
    entry = lambda k, *fields: F.struct(F.lit(k).alias("k"), *fields)
    limits = brackets.select(
        *[F.col(c).alias(n) for c, n in zip(by, keys)],
        F.explode(
            F.array(*[entry(k, F.get(f"_q{k}", F.lit(0)).alias("low"), F.get(f"_q{k}", F.lit(1)).alias("high"), F.col(f"_n{k}").alias("n")) for k in range(len(names))])
        ).alias("e"),
    ).select(*keys, "e.*").filter("n > 0")
    rows = wide.select(
        *by, F.explode(F.array(*[entry(k, F.col(f"_v{k}").alias("v")) for k in range(len(names))])).alias("r")
    ).select(*by, F.col("r.k").alias("_k"), F.col("r.v").alias("_v")).filter("_v IS NOT NULL")
    placed = rows.join(limits, [rows[c].eqNullSafe(limits[n]) for c, n in zip(by, keys)] + [rows["_k"] == limits["k"]])
    # Values below the bracket count as one, and so does what lies above it.
    value = F.when(F.col("_v").between(F.col("low"), F.col("high")), F.col("_v")).when(F.col("_v") < F.col("low"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    counts = placed.groupBy(*keys, "k", "n", value.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys, "k", "n").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("_upto", F.sum("_c").over(w))

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("_v")))

    found = ranked.groupBy(*keys, "k", "n").agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2.0).alias("_m"))
    each = found.groupBy(*keys).agg(*[F.max(F.when(F.col("k") == k, F.col("_m"))).alias(name) for k, name in enumerate(names)])
    out = brackets.join(each, [brackets[c].eqNullSafe(each[n]) for c, n in zip(by, keys)], "left")
    return out.drop(*keys, *[f"_q{k}" for k in range(len(names))], *[f"_n{k}" for k in range(len(names))])
