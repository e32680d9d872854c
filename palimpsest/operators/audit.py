"""Reports over the audit log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.dims import GRID_G_PER_KWH
from palimpsest.functions.energy import BOUNDS, uncached_share, saved_columns, watt_hours
from palimpsest.operators.prune import reduction
from palimpsest.operators.sequence import Layout, number_rows


def rollup(audit: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    """Requests, tokens before and after, tokens saved and reduction, per group or in total."""
    totals = audit.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.coalesce(F.sum("tokens_before"), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("tokens_after"), F.lit(0)).alias("tokens_after"),
    )
    return totals.withColumns(
        {
            "tokens_saved": F.col("tokens_before") - F.col("tokens_after"),
            "reduction": reduction(F.col("tokens_before"), F.col("tokens_after")),
        }
    )


def estimates(totals: DataFrame, *, grid: str = "world", cache_hit: float = 0.0, cache_cost: float = 0.10,
              price_in: float | None = None) -> DataFrame:
    """Bounded energy and carbon, and USD, of the saved tokens of a roll-up.

    A price of 0 gives 0 USD here (the ledger gives none).
    """
    out = totals.withColumns(saved_columns(F.col("tokens_saved"), grid, cache_hit, cache_cost))
    usd = F.lit(None) if price_in is None else F.when(F.col("tokens_saved") > 0, F.col("tokens_saved") / 1e6 * price_in)
    return out.withColumn("usd_avoided", usd.cast("double"))


def energy_per_request(totals: DataFrame, *, strict: bool = True) -> DataFrame:
    """Energy before and after per group; the reduction does not depend on the coefficient.

    A group without tokens is an error: it has no reduction. With `strict` off such groups come with nulls and `valid` false.
    """
    ok = F.coalesce(F.col("tokens_before") > 0, F.lit(False))
    wrong = F.raise_error(F.lit("tokens_before must be positive")).cast("bigint") if strict else F.lit(None).cast("bigint")
    before, after = F.when(ok, F.col("tokens_before")).otherwise(wrong), F.when(ok, F.col("tokens_after"))
    energy = {f"wh_before_{b}": watt_hours(before, b) for b in BOUNDS} | {f"wh_after_{b}": watt_hours(after, b) for b in BOUNDS}
    return totals.withColumns(energy | {"reduction": F.when(ok, F.col("reduction")), "valid": ok})


def session_totals(audit: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return audit.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("tokens_before").alias("tokens_before"),
        F.sum("tokens_after").alias("tokens_after"),
        F.sum("blocks_purged").alias("blocks_purged"),
        F.greatest(F.max("reduction"), F.lit(0.0)).alias("peak_reduction"),
    )


def model_totals(audit: DataFrame) -> DataFrame:
    return rollup(audit, [F.coalesce(F.col("model"), F.lit("?")).alias("model")])


def top_models(audit: DataFrame, limit: int = 8) -> DataFrame:
    """Models by tokens saved, names break ties."""
    return model_totals(audit).orderBy(F.desc("tokens_saved"), F.asc("model")).limit(limit)


def latest_requests(audit: DataFrame, order: Sequence[Column], limit: int = 10) -> DataFrame:
    """The newest rows; a distributed top-k, never a full sort."""
    return audit.orderBy(*order).limit(limit)


def rolling_stats(audit: DataFrame, keys: Sequence[str], order: str, *, window: int = 240, block_rows: int = 0) -> DataFrame:
    """Per row, over the last `window` rows: upper median and maximum of the latency, mean reduction."""
    numbered = number_rows(audit, keys, order, block_rows, "_pos")
    layout = Layout(keys, "_pos", block_rows)
    spread = layout.with_halo(numbered, before=window - 1)
    frame = layout.window().rowsBetween(-(window - 1), Window.currentRow)
    values = F.sort_array(F.collect_list("kernel_latency_us").over(frame))
    return (
        spread.select(
            "*",
            F.get(values, F.floor(F.size(values) / 2).cast("int")).alias("latency_p50"),
            F.max("kernel_latency_us").over(frame).alias("latency_max"),
            F.avg("reduction").over(frame).alias("mean_reduction"),
            F.count(F.lit(1)).over(frame).alias("window_rows"),
        )
        .filter(~F.col("_halo"))
        .drop("_halo", "_pos", "_block")
    )


def thin_curve(rows: DataFrame, keys: Sequence[str], order: str, *, points: int = 12, block_rows: int = 0) -> DataFrame:
    """Every max(1, n div points)-th row of each group, and its last row; `row_no` counts from 1."""
    numbered = number_rows(rows, keys, order, block_rows, "_pos")
    layout = Layout(keys, "_pos", block_rows)
    sized = layout.carry(layout.split(numbered), totals={"_n": F.lit(1)}, reuse=True)
    step = F.greatest(F.floor(F.col("_n") / points), F.lit(1))
    chosen = (F.col("_pos") % step == 0) | (F.col("_pos") == F.col("_n") - 1)
    return layout.merge(sized.filter(chosen).withColumn("row_no", F.col("_pos") + 1).drop("_pos", "_n"))


def hibernation_use(audit: DataFrame, *, approximate: bool = False) -> DataFrame:
    """References to stored units and how many distinct units they name."""
    refs = audit.select(F.explode("purged_hashes").alias("digest"))
    if approximate:
        return refs.agg(F.count(F.lit(1)).alias("references"), F.approx_count_distinct("digest").alias("unique_units"))
    per_digest = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    return per_digest.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("references"), F.count(F.lit(1)).alias("unique_units")
    )


def cache_use(calls: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cache tokens read and written and the hit rate over all input tokens."""
    sums = calls.groupBy(*by).agg(
        F.sum("cache_read").alias("cache_read"),
        F.sum("cache_write").alias("cache_write"),
        F.sum("uncached_in").alias("uncached_in"),
    )
    every = F.col("cache_read") + F.col("cache_write") + F.col("uncached_in")
    return sums.withColumn("hit_rate", F.try_divide(F.col("cache_read").cast("double"), every.cast("double")))


def compare_configs(control: DataFrame, tuned: DataFrame, on: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Two roll-ups side by side with the relative change of every measure."""
    left = control.select(*on, *[F.col(m).alias(f"{m}_control") for m in measures])
    right = tuned.select(*on, *[F.col(m).alias(f"{m}_tuned") for m in measures])
    both = left.join(right, list(on)) if on else left.crossJoin(right)
    return both.withColumns(
        {
            f"{m}_change": F.try_divide(
                (F.col(f"{m}_tuned") - F.col(f"{m}_control")).cast("double"), F.col(f"{m}_control").cast("double")
            )
            for m in measures
        }
    )


def deployment_projection(totals: DataFrame, *, dispatches_per_day: float, cache_hit: float = 0.0,
                          cache_cost: float = 0.10) -> DataFrame:
    """Yearly MWh and t CO2e avoided per grid, from the mean saving per request."""
    factor = uncached_share(cache_hit, cache_cost)
    per_request = F.try_divide(F.col("tokens_saved").cast("double"), F.col("requests").cast("double"))
    yearly = F.floor(per_request * dispatches_per_day * 365)
    grids = F.array(
        *[F.struct(F.lit(g).alias("grid"), F.lit(v).alias("g_per_kwh")) for g, v in GRID_G_PER_KWH.items()]
    )
    out = totals.select("*", yearly.alias("tokens_per_year"), F.inline(grids))
    return out.withColumns(
        {f"mwh_{b}": watt_hours(F.col("tokens_per_year"), b, factor) / 1e6 for b in BOUNDS}
        | {f"tco2e_{b}": watt_hours(F.col("tokens_per_year"), b, factor) / 1e9 * F.col("g_per_kwh") for b in BOUNDS}
    )
