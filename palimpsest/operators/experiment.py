"""Paired experiments: a baseline arm against a treated arm.

Pairs are rows of one (model, task, rep) in both arms. All reports are grouped aggregates over the
pairs; prices and tiers come from a small roster.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.dims import small
from palimpsest.functions import stats
from palimpsest.functions.energy import saved_columns, watt_hours
from palimpsest.operators.ranks import ranks, same_keys
from palimpsest.operators.selection import exact_medians

BASELINE = "baseline"
TREATED = "treated"
PAIR_KEYS = ["model", "task", "rep"]
EXACT_LIMIT = 50
STALE_ORDER = ["high", "medium", "low"]


def pair_arms(rows: DataFrame, keys: Sequence[str] = PAIR_KEYS, order: str = "ingest_seq",
              arms: tuple[str, str] = (BASELINE, TREATED)) -> DataFrame:
    """One row per key with structs `a` (first arm) and `b` (second arm); keys without both fall out.

    Of duplicate rows the latest wins. One aggregation does the de-duplication and the join; the
    latest row per key and arm is found on the map side already.
    """
    rest = [c for c in rows.columns if c not in (*keys, "arm")]
    row = F.struct(*rest)

    def latest(arm: str) -> Column:
        chosen = F.col("arm") == arm
        return F.max_by(F.when(chosen, row), F.when(chosen, F.col(order)))

    paired = rows.groupBy(*keys).agg(latest(arms[0]).alias("a"), latest(arms[1]).alias("b"))
    return paired.filter(F.col("a").isNotNull() & F.col("b").isNotNull())


def input_reduction_pct(pairs: DataFrame) -> Column:
    a, b = F.col("a.input_tokens"), F.col("b.input_tokens")
    return F.when(a > 0, (a - b) / a * 100.0).otherwise(0.0)


def rate(flag: Column) -> Column:
    return F.avg(F.coalesce(flag, F.lit(False)).cast("int"))


def pair_sums(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    low, high = stats.mean_interval(input_reduction_pct(pairs))
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg(input_reduction_pct(pairs)).alias("mean_reduction_pct"),
        low.alias("reduction_low"),
        high.alias("reduction_high"),
        rate(a["success"]).alias("success_a"),
        rate(b["success"]).alias("success_b"),
        F.sum(a["input_tokens"] - b["input_tokens"]).alias("input_saved"),
        F.sum(a["output_tokens"] - b["output_tokens"]).alias("output_saved"),
        F.sum(a["input_tokens"]).alias("input_a"),
        F.sum(b["input_tokens"]).alias("input_b"),
    )


def with_prices(frame: DataFrame, roster: DataFrame) -> DataFrame:
    return frame.join(small(roster), "model")


def unpriced_models(frame: DataFrame, roster: DataFrame) -> DataFrame:
    return frame.select("model").distinct().join(small(roster.select("model")), "model", "left_anti")


def model_report(pairs: DataFrame, roster: DataFrame) -> DataFrame:
    """Per model: pairs, mean reduction with its 95 % bootstrap interval, success rates, tokens, list-price dollars and energy saved."""
    priced = with_prices(pair_sums(pairs, ["model"]), roster)
    saved = F.col("input_saved") + F.col("output_saved")
    out = priced.withColumns(
        {
            "tokens_saved": saved,
            "dollars_saved": F.col("input_saved") / 1e6 * F.col("price_in")
            + F.col("output_saved") / 1e6 * F.col("price_out"),
        }
    )
    energy = saved_columns(F.col("tokens_saved"))
    return out.withColumns({"wh_saved_mid": energy["wh_mid"], "gco2e_saved_mid": energy["gco2e_mid"]})


def cross_tier(report: DataFrame) -> DataFrame:
    """The report ordered by tier, then by reduction, largest first."""
    return report.orderBy("tier", F.desc("mean_reduction_pct"), "model")


def stale_breakdown(pairs: DataFrame) -> DataFrame:
    """Pooled over models by the staleness label of the baseline row, high to low, with the 95 % bootstrap interval of the reduction."""
    labelled = pairs.withColumn("stale_ratio", F.col("a.stale_ratio")).filter(F.col("stale_ratio").isin(STALE_ORDER))
    place = F.array_position(F.array(*[F.lit(s) for s in STALE_ORDER]), F.col("stale_ratio"))
    return pair_sums(labelled, ["stale_ratio"]).orderBy(place)


def chart_stats(pairs: DataFrame) -> DataFrame:
    """Medians per model (interpolated), mean tokens saved and success rates."""
    a, b = F.col("a"), F.col("b")
    means = [
        F.count(F.lit(1)).alias("n_pairs"),
        rate(a["success"]).alias("success_a"),
        rate(b["success"]).alias("success_b"),
        F.avg(a["input_tokens"] - b["input_tokens"]).alias("mean_input_saved"),
    ]
    medians = {
        "median_a": a["input_tokens"],
        "median_b": b["input_tokens"],
        "median_reduction_pct": input_reduction_pct(pairs),
    }
    return exact_medians(pairs, ["model"], medians, also=means)


def usd_per_thousand(stats_frame: DataFrame, roster: DataFrame) -> DataFrame:
    """List-price input saving per 1,000 sessions, frontier tier first, largest first."""
    priced = with_prices(stats_frame, roster)
    usd = F.col("mean_input_saved") * F.col("price_in") / 1e6 * 1000
    return priced.withColumn("usd_per_1k", usd).orderBy(F.col("tier") != "frontier", F.desc("usd_per_1k"), "model")


def input_energy(pairs: DataFrame, roster: DataFrame) -> DataFrame:
    """Input energy per arm and model, frontier tier first, largest saving first."""
    sums = with_prices(pair_sums(pairs, ["model"]), roster)
    out = sums.select(
        "model",
        "tier",
        "n_pairs",
        watt_hours(F.col("input_a"), "mid").alias("wh_a"),
        watt_hours(F.col("input_b"), "mid").alias("wh_b"),
    )
    return out.orderBy(F.col("tier") != "frontier", F.desc(F.col("wh_a") - F.col("wh_b")), "model")


def quality_points(pairs: DataFrame) -> DataFrame:
    """Mean reduction and treated success per model and task, and the pooled baseline rate."""
    usable = pairs.filter(F.col("a.input_tokens") > 0)
    points = usable.groupBy("model", "task").agg(
        F.avg(input_reduction_pct(pairs)).alias("mean_reduction_pct"), rate(F.col("b.success")).alias("success_b")
    )
    pooled = pairs.agg(rate(F.col("a.success")).alias("baseline_rate"))
    return points.crossJoin(F.broadcast(pooled))


def parity(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Success parity matrix; divergent pairs are those where only one arm succeeds."""
    a = F.coalesce(F.col("a.success"), F.lit(False))
    b = F.coalesce(F.col("b.success"), F.lit(False))
    return pairs.groupBy(*by).agg(
        F.count_if(a & b).alias("both_ok"),
        F.count_if(~a & ~b).alias("both_fail"),
        F.count_if(a & ~b).alias("a_only"),
        F.count_if(~a & b).alias("b_only"),
        F.count_if(a != b).alias("divergent"),
    )


def worst_losses(pairs: DataFrame, limit: int = 5) -> DataFrame:
    """Model and task with the largest loss of successes over the reps."""
    a = F.coalesce(F.col("a.success"), F.lit(False)).cast("int")
    b = F.coalesce(F.col("b.success"), F.lit(False)).cast("int")
    sums = pairs.groupBy("model", "task").agg(
        F.sum(b - a).alias("delta"), F.sum(a).alias("ok_a"), F.sum(b).alias("ok_b"), F.count(F.lit(1)).alias("reps")
    )
    return sums.orderBy("delta", "model", "task").limit(limit)


def arm_totals(pairs: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Sum of each measure in both arms and the percentage saved."""
    aggs = []
    for m in measures:
        aggs += [F.sum(F.col(f"a.{m}")).alias(f"{m}_a"), F.sum(F.col(f"b.{m}")).alias(f"{m}_b")]
    sums = pairs.agg(*aggs)
    return sums.withColumns(
        {
            f"{m}_saved_pct": 100.0 * F.try_divide((F.col(f"{m}_a") - F.col(f"{m}_b")).cast("double"), F.col(f"{m}_a").cast("double"))
            for m in measures
        }
    )


def cost_per_solved(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.coalesce(F.col("success"), F.lit(False))).alias("solved"),
        F.sum("cost_usd").alias("cost_usd"),
    )
    return sums.withColumn("usd_per_solved", F.try_divide(F.col("cost_usd"), F.col("solved").cast("double")))


def refusals(rows: DataFrame, by: Sequence[str], answered: Column) -> DataFrame:
    """Hard refusals (flagged, no answer), soft flags (flagged but answered) and useful answers."""
    flagged = F.col("refusal").isNotNull()
    return rows.groupBy(*by).agg(
        F.count_if(flagged & ~answered).alias("hard_refusals"),
        F.count_if(flagged & answered).alias("soft_flags"),
        F.count_if(answered).alias("useful_answers"),
    )


def scenario_verdict(cells: DataFrame) -> DataFrame:
    """Verdict over scenario cells: base_score, treated_score, reduction, expected_degradation, error."""
    ok = F.col("error").isNull()
    core = ok & ~F.col("expected_degradation")
    limit = ok & F.col("expected_degradation")
    return cells.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(ok).alias("valid"),
        F.count_if(core).alias("core"),
        F.count_if(core & (F.col("treated_score") >= F.col("base_score"))).alias("parity"),
        F.count_if(core & (F.col("treated_score") == 1.0)).alias("perfect"),
        F.avg(F.when(core, F.col("reduction"))).alias("mean_reduction"),
        F.count_if(limit & (F.col("treated_score") < F.col("base_score"))).alias("expected_losses"),
    )


def trial_medians(rows: DataFrame, by: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Median of each measure per arm and the reduction in percent."""
    medians = {}
    for m in measures:
        for side, arm in (("a", BASELINE), ("b", TREATED)):
            medians[f"{m}_{side}"] = F.when(F.col("arm") == arm, F.col(m))
    out = exact_medians(rows, by, medians)
    return out.withColumns(
        {f"{m}_reduction_pct": 100.0 * (1.0 - F.try_divide(F.col(f"{m}_b"), F.col(f"{m}_a"))) for m in measures}
    )


def cost_matrix(totals: DataFrame, roster: DataFrame, *, reps: int, output_per_call: int) -> DataFrame:
    """Forecast cost of both arms per model. Totals: tasks, input_a, input_b of one sweep (one row)."""
    out_tokens = F.col("tasks") * reps * output_per_call
    each = totals.crossJoin(small(roster))

    def cost(tokens: str) -> Column:
        return F.col(tokens) * reps / 1e6 * F.col("price_in") + out_tokens / 1e6 * F.col("price_out")

    return each.select(
        "model", "tier", cost("input_a").alias("usd_a"), cost("input_b").alias("usd_b")
    ).withColumn("usd_total", F.col("usd_a") + F.col("usd_b"))


def first_tasks(rows: DataFrame, tasks: int, reps: int | None = None) -> DataFrame:
    """Rows of the first `tasks` tasks and the first `reps` reps; the task list is a top-k, not a sort."""
    chosen = rows.select("task").distinct().orderBy("task").limit(tasks)
    out = rows.join(chosen, "task", "left_semi")
    return out if reps is None else out.filter(F.col("rep") < reps)


def both_arms(baseline: DataFrame, treated: DataFrame) -> DataFrame:
    """One frame with an `arm` column."""
    return baseline.withColumn("arm", F.lit(BASELINE)).unionByName(treated.withColumn("arm", F.lit(TREATED)))


def average_ranks(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with count and average-tie rank; see `ranks` for how large groups are split."""
    found = ranks(values, by, value).rows
    return found.select(*by, value, "ties", (F.col("below") + (F.col("ties") + 1) / 2.0).alias("avg_rank"))


def wilcoxon(pairs: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Signed-rank test of the input tokens: W = min(W+, W-), z (tie-corrected) and two-sided p.

    Exact p for up to 50 differences without ties or zeros, else the normal approximation. Groups of
    fewer than two pairs, or without any difference, get nulls.
    """
    by = list(by)
    diff = F.col("a.input_tokens") - F.col("b.input_tokens")
    # Arms that agree within these tolerances everywhere count as equal.
    close = F.abs(diff) <= 1e-8 + 1e-5 * F.abs(F.col("b.input_tokens"))
    rows = pairs.select(*by, F.abs(diff).alias("_abs"), (diff > 0).alias("_positive"), close.alias("_close"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"), F.bool_and("_close").alias("_equal"))
    real = ranks(rows.filter("_abs > 0"), by, "_abs", {"_up": F.count_if("_positive")}).rows
    rank = F.col("below") + (F.col("ties") + 1) / 2.0
    names = {c: f"_{c}" for c in by}
    sums = real.groupBy(*by).agg(
        F.sum("ties").alias("n"),
        F.sum(rank * F.col("_up")).alias("_plus"),
        F.sum(rank * (F.col("ties") - F.col("_up"))).alias("_minus"),
        F.sum(F.pow("ties", F.lit(3.0)) - F.col("ties")).alias("_tie"),
    ).withColumnsRenamed(names)
    tested = sizes.join(sums, same_keys(sizes, sums, by, names), "left").drop(*names.values())
    tested = tested.withColumn("_ok", (F.col("n_pairs") >= 2) & ~F.col("_equal"))
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4.0
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_tie") / 48.0)
    stat = F.least("_plus", "_minus")
    tested = tested.withColumns(
        {
            "statistic": F.when(F.col("_ok"), stat),
            "z": F.when(F.col("_ok"), F.try_divide(stat - mean, spread)),
        }
    )
    spark = pairs.sparkSession
    table = spark.createDataFrame(stats.exact_signed_rank(EXACT_LIMIT), "n BIGINT, statistic DOUBLE, _exact DOUBLE")
    joined = tested.join(F.broadcast(table), ["n", "statistic"], "left")
    exact = (F.col("_tie") == 0) & (F.col("n") == F.col("n_pairs")) & F.col("_exact").isNotNull()
    p = F.when(exact, F.col("_exact")).otherwise(stats.two_sided_p(F.col("z")))
    return joined.select(*by, "n_pairs", F.coalesce("n", F.lit(0)).alias("n"), "statistic", "z",
                         F.when(F.col("_ok"), p).alias("p_value"))


def bootstrap_ci(values: DataFrame, by: Sequence[str], value: str, *, statistic: str = "mean") -> DataFrame:
    """95 % bootstrap interval (2.5 and 97.5 percentiles) of the mean or median of each group; nulls left out.

    Neither is drawn. The mean's percentiles come from the cumulants of its bootstrap distribution (`stats.mean_interval`). The
    median's are exact: the m-th smallest of n draws is at most the value of rank r with a binomial chance, which gives the rank
    of each limit, and the value of a rank is found by counting. With an even n, both middle draws have their limits, and the
    mean of the two is taken. The same rule holds for every n.
    """
    if statistic not in ("mean", "median"):
        raise ValueError("statistic must be mean or median")
    by = list(by)
    rows = values.select(*by, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL")
    if statistic == "mean":
        low, high = stats.mean_interval(F.col("_x"))
        return rows.groupBy(*by).agg(low.alias("ci_low"), high.alias("ci_high"))

    @F.arrow_udf("array<struct<name: string, rank: bigint>>")
    def limits(sizes: pa.Array) -> pa.Array:
        out = []
        for n in sizes.to_pylist():
            middles = ((n + 1) // 2, n // 2 + 1)
            out.append([{"name": name, "rank": stats.rank_of_middle(n, m, p)} for name, p in (("low", 0.025), ("high", 0.975)) for m in middles])
        return pa.array(out, pa.list_(pa.struct([("name", pa.string()), ("rank", pa.int64())])))

    found = ranks(rows, by, "_x")
    wanted = found.sizes().select(*by, F.explode(limits("n")).alias("w")).select(*by, "w.name", "w.rank")
    at = found.at(wanted.distinct())  # both middle draws may want one rank
    limit = lambda name: ((F.min(F.when(F.col("name") == name, F.col("_x"))) + F.max(F.when(F.col("name") == name, F.col("_x")))) / 2.0)
    return at.groupBy(*by).agg(limit("low").alias("ci_low"), limit("high").alias("ci_high"))
