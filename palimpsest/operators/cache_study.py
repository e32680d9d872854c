"""Cost studies on prompt caching: four-arm sessions, crossover, and growing conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.experiment import BASELINE, TREATED
from palimpsest.operators.lineage import cut
from palimpsest.operators.selection import exact_medians

# Fixed value: below this baseline session cost the call was refused for free.
FREE_SESSION_USD = 5e-4
# USD per million tokens of the cache-interaction study.
STUDY_PRICES = {"in": 2.0, "write": 2.5, "read": 0.2, "out": 10.0}
CELLS = [("bc", BASELINE, True), ("bn", BASELINE, False), ("mc", TREATED, True), ("mn", TREATED, False)]


def sessions_from_calls(calls: DataFrame) -> DataFrame:
    """Session row per (model, task, arm, cache): total, cold and warm cost, first prompt size."""
    first, second = F.col("call_index") == 0, F.col("call_index") == 1
    return calls.groupBy("model", "task", "arm", "cache").agg(
        F.count(F.lit(1)).alias("warmup"),
        F.sum("cost_usd").alias("session_cost_usd"),
        F.bool_or(F.col("cache_write_tokens") > 0).alias("cacheable"),
        F.max(F.when(first, F.col("cost_usd"))).alias("cold_cost_usd"),
        F.max(F.when(second, F.col("cost_usd"))).alias("warm_cost_usd"),
        F.max(F.when(first, F.col("prompt_tokens"))).alias("prompt_tokens"),
    )


def pivot_cells(sessions: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per (model, task) with the four (arm, cache) rows as structs, null where missing."""
    row = F.struct("session_cost_usd", "cold_cost_usd", "warm_cost_usd", "cacheable", "warmup")
    aggs = []
    for name, arm, cache in CELLS:
        chosen = (F.col("arm") == arm) & (F.col("cache") == cache)
        picked = F.when(chosen, row)
        aggs.append((F.max(picked) if order is None else F.max_by(picked, F.when(chosen, order))).alias(name))
    return sessions.groupBy("model", "task").agg(*aggs)


def complete(cells: DataFrame) -> DataFrame:
    return cells.filter(" AND ".join(f"{n} IS NOT NULL" for n, *_ in CELLS))


def skipped(cells: DataFrame) -> DataFrame:
    """Cells that lack an arm, with the missing ones."""
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n, *_ in CELLS]))
    return cells.select("model", "task", missing.alias("missing")).filter(F.size("missing") > 0)


def crossover(cold_b: Column, warm_b: Column, cold_m: Column, warm_m: Column) -> Column:
    """Smallest number of calls from which the baseline with cache is the cheaper one; null if never.

    Costs are rounded to 9 decimals first, so that equal costs give equal results on every engine.
    """
    cold_gap, warm_gap = F.round(cold_m - cold_b, 9), F.round(warm_b - warm_m, 9)
    k = F.ceil(F.round(F.try_divide(cold_gap, warm_gap), 9) + 1).cast("bigint")
    known = F.coalesce((warm_b > 0) & (warm_m > 0), F.lit(False))
    return F.when(known & (warm_gap < 0), F.greatest(k, F.lit(1).cast("bigint")))


def study_cells(cells: DataFrame) -> DataFrame:
    """Per complete cell: saving on top of caching, crossover, and whether it is informative."""
    bc, mc = F.col("bc"), F.col("mc")
    saving = 100.0 * F.try_divide(bc["session_cost_usd"] - mc["session_cost_usd"], bc["session_cost_usd"])
    return complete(cells).select(
        "model",
        "task",
        (bc["session_cost_usd"] >= FREE_SESSION_USD).alias("informative"),
        saving.alias("saving_pct"),
        F.coalesce(mc["cacheable"], F.lit(False)).alias("cacheable"),
        crossover(bc["cold_cost_usd"], bc["warm_cost_usd"], mc["cold_cost_usd"], mc["warm_cost_usd"]).alias("k"),
    )


def study_summary(cells: DataFrame) -> DataFrame:
    """Per model and pooled (model null): saving, cacheable cells, crossover; free cells are only counted."""
    ok = F.col("informative")
    cells = cut(study_cells(cells))  # read by both passes over the medians, and twice in each
    per_model = cells.withColumn("scope", F.struct(F.col("model")))
    pooled = cells.withColumn("scope", F.struct(F.lit(None).cast("string").alias("model")))
    out = exact_medians(
        per_model.unionByName(pooled),
        ["scope"],
        {"median_saving_pct": F.when(ok, F.col("saving_pct")), "median_k": F.when(ok, F.col("k"))},
        also=[
            F.count_if(ok).alias("cells"),
            F.count_if(~ok).alias("excluded"),
            F.min(F.when(ok, F.col("saving_pct"))).alias("min_saving_pct"),
            F.max(F.when(ok, F.col("saving_pct"))).alias("max_saving_pct"),
            F.count_if(ok & F.col("cacheable")).alias("cacheable_cells"),
            F.count_if(ok & F.col("k").isNull()).alias("never_crossed"),
            F.min(F.when(ok, F.col("k"))).alias("min_k"),
            F.max(F.when(ok, F.col("k"))).alias("max_k"),
        ],
    )
    return out.select(
        "scope.model", "cells", "excluded", "median_saving_pct", "min_saving_pct", "max_saving_pct", "cacheable_cells", "never_crossed",
        F.floor("median_k").cast("bigint").alias("median_k"), "min_k", "max_k",
    )


def cost_curve(cells: DataFrame, calls: int = 30) -> DataFrame:
    """Session cost of both cached arms for 1 .. calls calls, from the median cold and warm costs."""
    usable = cells.filter(
        (F.col("bc.session_cost_usd") >= FREE_SESSION_USD)
        & F.col("bc.warm_cost_usd").isNotNull()
        & F.col("mc.warm_cost_usd").isNotNull()
    )
    medians = exact_medians(
        usable, ["model"], {f"{cell}_{kind}": F.col(f"{cell}.{kind}_cost_usd") for cell in ("bc", "mc") for kind in ("cold", "warm")}
    )
    points = medians.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(calls))))
    more = F.col("k") - 1
    return points.select(
        "model",
        F.col("k").cast("bigint").alias("k"),
        (F.col("bc_cold") + more * F.col("bc_warm")).alias("usd_a"),
        (F.col("mc_cold") + more * F.col("mc_warm")).alias("usd_b"),
    )


def step_medians(rows: DataFrame) -> DataFrame:
    """Median cost and prompt size per model, arm and step of the growing study."""
    by = ["model", "arm", "step"]
    medians = {"median_cost": F.col("cost_usd"), "median_tokens": F.col("prompt_tokens")}
    return exact_medians(rows, by, medians, also=[F.max("history_turns").alias("history_turns")])


def cumulative_costs(medians: DataFrame) -> DataFrame:
    """Running cost per model and arm over the steps (a bounded number of rows per arm)."""
    w = Window.partitionBy("model", "arm").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return medians.withColumn("cumulative_cost", F.sum("median_cost").over(w))


def growing_summary(medians: DataFrame) -> DataFrame:
    """Per model: total cost of both arms, saving, and the ratio of prompt sizes at the last step."""
    running = cumulative_costs(medians)

    def at_end(arm: str, column: str) -> Column:
        chosen = F.col("arm") == arm
        return F.max_by(F.when(chosen, F.col(column)), F.when(chosen, F.col("step")))

    ends = running.groupBy("model").agg(
        F.max("step").alias("steps"),
        at_end(BASELINE, "cumulative_cost").alias("usd_a"),
        at_end(TREATED, "cumulative_cost").alias("usd_b"),
        at_end(BASELINE, "median_tokens").alias("last_tokens_a"),
        at_end(TREATED, "median_tokens").alias("last_tokens_b"),
    )
    return ends.withColumns(
        {
            "saved_pct": 100.0 * (1.0 - F.try_divide(F.col("usd_b"), F.col("usd_a"))),
            "token_ratio": F.try_divide(F.col("last_tokens_a"), F.col("last_tokens_b")),
        }
    )


def billed_cost(calls: DataFrame, by: Sequence[str] = (), prices: dict[str, float] | None = None) -> DataFrame:
    """Cost from list prices, cached tokens apart; uncached input never goes below zero."""
    p = STUDY_PRICES if prices is None else prices
    uncached = F.greatest(F.col("input_tokens") - F.col("cache_read") - F.col("cache_write"), F.lit(0))
    cost = (
        uncached * p["in"]
        + F.col("cache_write") * p["write"]
        + F.col("cache_read") * p["read"]
        + F.col("output_tokens") * p["out"]
    ) / 1e6
    return calls.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum(cost).alias("billed_usd"))


def call_cost(provider_cost: Column, input_tokens: Column, output_tokens: Column, price_in: Column, price_out: Column) -> Column:
    """Cost the provider reported, else list price; models without one get the fallback price."""
    from palimpsest.dims import FALLBACK_PRICE_IN, FALLBACK_PRICE_OUT

    listed = input_tokens / 1e6 * F.coalesce(price_in, F.lit(FALLBACK_PRICE_IN)) + output_tokens / 1e6 * F.coalesce(
        price_out, F.lit(FALLBACK_PRICE_OUT)
    )
    return F.coalesce(provider_cost, listed)
