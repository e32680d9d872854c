"""Paired experiments and cache studies over the replayed requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import dims
from palimpsest.operators import cache_study as CS
from palimpsest.operators import experiment as X
from palimpsest.operators import replay
from palimpsest.plans.audits import MODELS, MODELS_SQL
from palimpsest.plans.pruning import long_signals, replay_sql, rounded
from palimpsest.plans.registry import query
from palimpsest.sources import tables
from palimpsest.sources.experiment_rows import read_results, read_summary, valid_rows
from palimpsest.streaming.sinks import scratch

STALE = ["high", "medium", "low"]


def raw_results(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows of both arms, with errors and superseded duplicates, as a runner would log them."""
    sessions = long_signals(spark, sf)
    requests = replay.replay_requests(sessions.rows, sessions.config())
    session, pos, no = F.col("session_id"), F.col("request_pos"), F.col("request_no")
    base = requests.select(
        F.concat(F.lit("task-"), session.cast("string")).alias("task"),
        F.get(F.array(*[F.lit(s) for s in STALE]), (session % 3).cast("int")).alias("stale_ratio"),
        F.get(F.array(*[F.lit(m) for m in MODELS]), ((no - 1) % 8).cast("int")).alias("model"),
        F.floor((no - 1) / 8).cast("bigint").alias("rep"),
        pos.alias("pos"),
        session.alias("sid"),
        (F.col("tokens_before") + F.col("request_tokens")).alias("input_a"),
        (F.col("tokens_after") + F.col("request_tokens")).alias("input_b"),
    )

    p, s = F.col("pos"), F.col("sid")
    arms = F.array(
        F.struct(F.lit(X.BASELINE).alias("arm"), F.lit(0).alias("number"), F.col("input_a").alias("input_tokens")),
        F.struct(F.lit(X.TREATED).alias("arm"), F.lit(1).alias("number"), F.col("input_b").alias("input_tokens")),
    )
    # Some rows were logged twice; the second version supersedes the first.
    versions = F.when(p % 19 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = base.withColumn("arms", F.explode(arms)).select("*", "arms.*").withColumn("again", F.explode(versions))
    number, again = F.col("number"), F.col("again")
    success = (p * 7 + s * 3 + number * 5) % 10 < 8
    output = 100 + (p * 37 + number * 13) % 200 + again
    return rows.select(
        "arm",
        "task",
        "stale_ratio",
        "model",
        "rep",
        (p * 1000 + s * 10 + again).alias("ingest_seq"),
        F.lit(False).alias("mock"),
        "input_tokens",
        output.alias("output_tokens"),
        ((p * 11 + number * 400) % 900).alias("reasoning_tokens"),
        F.when(again == 1, ~success).otherwise(success).alias("success"),
        F.when((p + number) % 17 == 0, "filtered").alias("refusal"),
        (F.col("input_tokens") / 1000.0 + number).alias("latency_s"),
        F.when((p % 23 == 5) & (s % 2 == number), "timeout").alias("error"),
        (F.col("input_tokens") / 1e6 * 3.0 + output / 1e6 * 15.0).alias("cost_usd"),
    )


def results(spark: SparkSession, sf: str) -> DataFrame:
    return valid_rows(raw_results(spark, sf))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return X.pair_arms(results(spark, sf))


def arm_sql(number: int, name: str, tokens: str) -> str:
    return f"""SELECT '{name}' AS arm, 'task-' || session_id AS task, ['high', 'medium', 'low'][(session_id % 3 + 1)::INT] AS stale_ratio,
    {MODELS_SQL}[((request_no - 1) % 8 + 1)::INT] AS model, (request_no - 1) // 8 AS rep, request_pos * 1000 + session_id * 10 AS ingest_seq,
    {tokens} + request_tokens AS input_tokens, 100 + (request_pos * 37 + {number} * 13) % 200 AS output_tokens,
    (request_pos * 11 + {number} * 400) % 900 AS reasoning_tokens, (request_pos * 7 + session_id * 3 + {number} * 5) % 10 < 8 AS success,
    CASE WHEN (request_pos + {number}) % 17 = 0 THEN 'filtered' END AS refusal, ({tokens} + request_tokens) / 1000.0 + {number} AS latency_s,
    CASE WHEN request_pos % 23 = 5 AND session_id % 2 = {number} THEN 'timeout' END AS error, request_pos AS pos FROM replayed"""


RESULTS = f"""{replay_sql()}, arms AS ({arm_sql(0, 'baseline', 'tokens_before')} UNION ALL {arm_sql(1, 'treated', 'tokens_after')}),
logged AS (SELECT * FROM arms UNION ALL SELECT * REPLACE (ingest_seq + 1 AS ingest_seq, NOT success AS success,
  output_tokens + 1 AS output_tokens) FROM arms WHERE pos % 19 = 3),
results AS (SELECT * EXCLUDE (pos), input_tokens / 1e6 * 3.0 + output_tokens / 1e6 * 15.0 AS cost_usd FROM logged WHERE error IS NULL)"""

PAIRS = f"""{RESULTS}, latest AS (
  SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY model, task, rep, arm ORDER BY ingest_seq DESC) = 1),
pairs AS (
  SELECT a.model, a.task, a.rep, a.stale_ratio, a.input_tokens AS ain, b.input_tokens AS bin, a.output_tokens AS aout,
    b.output_tokens AS bout, a.success AS asucc, b.success AS bsucc, a.cost_usd AS acost, b.cost_usd AS bcost,
    a.reasoning_tokens AS areas, b.reasoning_tokens AS breas, a.refusal AS aref, b.refusal AS bref,
    CASE WHEN a.input_tokens > 0 THEN (a.input_tokens - b.input_tokens) / a.input_tokens * 100.0 ELSE 0 END AS red
  FROM latest a JOIN latest b USING (model, task, rep) WHERE a.arm = 'baseline' AND b.arm = 'treated'),
roster(model, tier, price_in, price_out) AS (VALUES {', '.join(f"('{m}', '{t}', {i}::DOUBLE, {o}::DOUBLE)" for m, t, i, o in dims.ROSTER)})"""


def mean_interval_sql(x: str) -> str:
    """Limits of the mean's bootstrap distribution over aggregates of x, from the central moments of the group."""
    m = lambda k: f"avg(pow({x} - mu, {k}))"
    z = 1.959963984540054
    skew, excess = f"({m(3)} / pow({m(2)}, 1.5) / sqrt(count(*)))", f"(({m(4)} / pow({m(2)}, 2) - 3) / count(*))"
    limit = lambda z: (f"CASE WHEN {m(2)} > 0 THEN least(greatest(any_value(mu) + sqrt({m(2)} / count(*)) * ({z} + {(z * z - 1) / 6!r} * {skew} "  # noqa: E731
                       f"+ ({(z**3 - 3 * z) / 24!r}) * {excess} - ({(2 * z**3 - 5 * z) / 36!r}) * {skew} * {skew}), min({x})), max({x})) ELSE any_value(mu) END")
    return f"round({limit(-z)}, 6) AS {{low}}, round({limit(z)}, 6) AS {{high}}"


REDUCTION_LIMITS = mean_interval_sql("red").format(low="reduction_low", high="reduction_high")

RATES = """round(avg(asucc::INT), 6) AS success_a, round(avg(bsucc::INT), 6) AS success_b"""


@query("arm_pairs", f"""{PAIRS} SELECT model, task, rep, ain AS input_a, bin AS input_b, aout AS output_a, bout AS output_b,
  asucc AS success_a, bsucc AS success_b FROM pairs""")
def arm_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select(
        "model",
        "task",
        "rep",
        F.col("a.input_tokens").alias("input_a"),
        F.col("b.input_tokens").alias("input_b"),
        F.col("a.output_tokens").alias("output_a"),
        F.col("b.output_tokens").alias("output_b"),
        F.col("a.success").alias("success_a"),
        F.col("b.success").alias("success_b"),
    )


@query("experiment_arms", f"""{RESULTS} SELECT arm, count(*) AS rows_in, sum(input_tokens)::BIGINT AS input_tokens,
  round(sum(cost_usd), 6) AS cost_usd FROM results GROUP BY arm""")
def experiment_arms(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).groupBy("arm").agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.sum("input_tokens").alias("input_tokens"),
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    )


REPORT = f"""{PAIRS}, rep AS (
  SELECT model, tier, count(*) AS n_pairs, round(avg(red), 6) AS mean_reduction_pct, {REDUCTION_LIMITS}, {RATES},
    (sum(ain - bin) + sum(aout - bout))::BIGINT AS tokens_saved,
    round(sum(ain - bin) / 1e6 * any_value(price_in) + sum(aout - bout) / 1e6 * any_value(price_out), 6) AS dollars_saved
  FROM (SELECT *, avg(red) OVER (PARTITION BY model) AS mu FROM pairs) JOIN roster USING (model) GROUP BY model, tier)"""
REPORT_COLUMNS = [
    "model", "tier", "n_pairs", "mean_reduction_pct", "reduction_low", "reduction_high", "success_a", "success_b", "tokens_saved", "dollars_saved",
    "wh_saved_mid", "gco2e_saved_mid",
]
REPORT_ROUNDED = ["mean_reduction_pct", "reduction_low", "reduction_high", "success_a", "success_b", "dollars_saved", "wh_saved_mid", "gco2e_saved_mid"]


@query("model_report", f"""{REPORT}
SELECT *, round(greatest(tokens_saved, 0) / 1e6 * 0.9 * 1000, 6) AS wh_saved_mid,
  round(greatest(tokens_saved, 0) / 1e6 * 0.9 * 445.0, 6) AS gco2e_saved_mid FROM rep""")
def model_report(spark: SparkSession, sf: str) -> DataFrame:
    report = X.model_report(pairs(spark, sf), dims.roster(spark)).select(*REPORT_COLUMNS)
    return rounded(report, *REPORT_ROUNDED)


@query("cross_tier_summary", f"""{REPORT}
SELECT model, tier, n_pairs, mean_reduction_pct, success_a, success_b, dollars_saved FROM rep
ORDER BY tier, mean_reduction_pct DESC, model""")
def cross_tier_summary(spark: SparkSession, sf: str) -> DataFrame:
    report = X.cross_tier(X.model_report(pairs(spark, sf), dims.roster(spark)))
    names = ["mean_reduction_pct", "success_a", "success_b", "dollars_saved"]
    return rounded(report.select("model", "tier", "n_pairs", *names), *names)


@query("stale_breakdown", f"""{PAIRS} SELECT stale_ratio, count(*) AS n_pairs, round(avg(red), 6) AS mean_reduction_pct, {REDUCTION_LIMITS}, {RATES}
FROM (SELECT *, avg(red) OVER (PARTITION BY stale_ratio) AS mu FROM pairs) GROUP BY stale_ratio""")
def stale_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    names = ["mean_reduction_pct", "reduction_low", "reduction_high", "success_a", "success_b"]
    return rounded(X.stale_breakdown(pairs(spark, sf)).select("stale_ratio", "n_pairs", *names), *names)


CHART = f"""{PAIRS}, st AS (SELECT model, count(*) AS n_pairs, median(ain) AS median_a, median(bin) AS median_b,
  round(median(red), 6) AS median_reduction_pct, {RATES}, avg(ain - bin) AS mean_saved FROM pairs GROUP BY model)"""


@query("chart_stats", f"""{CHART} SELECT * EXCLUDE (mean_saved), round(mean_saved, 6) AS mean_input_saved FROM st""")
def chart_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = X.chart_stats(pairs(spark, sf))
    return rounded(out, "median_reduction_pct", "success_a", "success_b", "mean_input_saved")


@query("chart_stats_bracketed", f"""{CHART} SELECT model, median_a, median_b, median_reduction_pct FROM st""")
def chart_stats_bracketed(spark: SparkSession, sf: str) -> DataFrame:
    out = X.chart_stats(pairs(spark, sf))
    return rounded(out.select("model", "median_a", "median_b", "median_reduction_pct"), "median_reduction_pct")


@query("usd_per_thousand_sessions", f"""{CHART} SELECT model, tier, n_pairs, round(mean_saved * price_in / 1e6 * 1000, 6) AS usd_per_1k
FROM st JOIN roster USING (model) ORDER BY tier <> 'frontier', usd_per_1k DESC, model""")
def usd_per_thousand_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = X.usd_per_thousand(X.chart_stats(pairs(spark, sf)), dims.roster(spark))
    return rounded(out.select("model", "tier", "n_pairs", "usd_per_1k"), "usd_per_1k")


@query("input_energy_by_model", f"""{PAIRS} SELECT model, tier, count(*) AS n_pairs, round(sum(ain) / 1e6 * 0.9 * 1000, 6) AS wh_a,
  round(sum(bin) / 1e6 * 0.9 * 1000, 6) AS wh_b FROM pairs JOIN roster USING (model) GROUP BY model, tier""")
def input_energy_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.input_energy(pairs(spark, sf), dims.roster(spark)), "wh_a", "wh_b")


@query("quality_points", f"""{PAIRS}, pooled AS (SELECT avg(asucc::INT) AS r FROM pairs)
SELECT model, task, round(avg(red), 6) AS mean_reduction_pct, round(avg(bsucc::INT), 6) AS success_b, round(any_value(r), 6) AS baseline_rate
FROM pairs, pooled WHERE ain > 0 GROUP BY model, task""")
def quality_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.quality_points(pairs(spark, sf)), "mean_reduction_pct", "success_b", "baseline_rate")


@query("success_parity", f"""{PAIRS} SELECT model, count(*) FILTER (asucc AND bsucc) AS both_ok, count(*) FILTER (NOT asucc AND NOT bsucc) AS both_fail,
  count(*) FILTER (asucc AND NOT bsucc) AS a_only, count(*) FILTER (NOT asucc AND bsucc) AS b_only, count(*) FILTER (asucc <> bsucc) AS divergent
FROM pairs GROUP BY model""")
def success_parity(spark: SparkSession, sf: str) -> DataFrame:
    return X.parity(pairs(spark, sf), ["model"])


@query("worst_losses", f"""{PAIRS} SELECT model, task, sum(bsucc::INT - asucc::INT)::BIGINT AS delta, sum(asucc::INT)::BIGINT AS ok_a,
  sum(bsucc::INT)::BIGINT AS ok_b, count(*) AS reps FROM pairs GROUP BY model, task ORDER BY delta, model, task LIMIT 5""")
def worst_losses(spark: SparkSession, sf: str) -> DataFrame:
    return X.worst_losses(pairs(spark, sf))


@query("arm_totals", f"""{PAIRS} SELECT sum(areas)::BIGINT AS reasoning_tokens_a, sum(breas)::BIGINT AS reasoning_tokens_b,
  sum(aout)::BIGINT AS output_tokens_a, sum(bout)::BIGINT AS output_tokens_b, round(sum(acost), 6) AS cost_usd_a, round(sum(bcost), 6) AS cost_usd_b,
  round(100.0 * (sum(areas) - sum(breas)) / sum(areas), 6) AS reasoning_tokens_saved_pct,
  round(100.0 * (sum(aout) - sum(bout)) / sum(aout), 6) AS output_tokens_saved_pct,
  round(100.0 * (sum(acost) - sum(bcost)) / sum(acost), 6) AS cost_usd_saved_pct FROM pairs""")
def arm_totals(spark: SparkSession, sf: str) -> DataFrame:
    measures = ["reasoning_tokens", "output_tokens", "cost_usd"]
    out = X.arm_totals(pairs(spark, sf), measures)
    return rounded(out, "cost_usd_a", "cost_usd_b", *[f"{m}_saved_pct" for m in measures])


@query("cost_per_solved_task", f"""{RESULTS} SELECT model, arm, count(*) AS calls, count(*) FILTER (success) AS solved, round(sum(cost_usd), 6) AS cost_usd,
  round(sum(cost_usd) / nullif(count(*) FILTER (success), 0), 6) AS usd_per_solved FROM results GROUP BY ALL""")
def cost_per_solved_task(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.cost_per_solved(results(spark, sf), ["model", "arm"]), "cost_usd", "usd_per_solved")


@query("refusal_breakdown", f"""{RESULTS} SELECT model, arm, count(*) FILTER (refusal IS NOT NULL AND output_tokens <= 150) AS hard_refusals,
  count(*) FILTER (refusal IS NOT NULL AND output_tokens > 150) AS soft_flags, count(*) FILTER (output_tokens > 150) AS useful_answers
FROM results GROUP BY ALL""")
def refusal_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return X.refusals(results(spark, sf), ["model", "arm"], F.col("output_tokens") > 150)


@query("scenario_verdict", f"""{PAIRS}, cells AS (SELECT *, (asucc::INT * 2 + (aout % 2)) / 3.0 AS base_score, (bsucc::INT * 2 + (bout % 2)) / 3.0 AS treated_score,
  stale_ratio = 'low' AS expected, red / 100 AS reduction, aref IS NOT NULL AS failed FROM pairs)
SELECT count(*) AS cells, count(*) FILTER (NOT failed) AS valid, count(*) FILTER (NOT failed AND NOT expected) AS core,
  count(*) FILTER (NOT failed AND NOT expected AND treated_score >= base_score) AS parity,
  count(*) FILTER (NOT failed AND NOT expected AND treated_score = 1) AS perfect,
  round(avg(reduction) FILTER (NOT failed AND NOT expected), 6) AS mean_reduction,
  count(*) FILTER (NOT failed AND expected AND treated_score < base_score) AS expected_losses FROM cells""")
def scenario_verdict(spark: SparkSession, sf: str) -> DataFrame:
    def score(side: str):
        return (F.col(f"{side}.success").cast("int") * 2 + F.col(f"{side}.output_tokens") % 2) / 3.0

    frame = pairs(spark, sf)
    cells = frame.select(
        score("a").alias("base_score"),
        score("b").alias("treated_score"),
        (F.col("a.stale_ratio") == "low").alias("expected_degradation"),
        (X.input_reduction_pct(frame) / 100).alias("reduction"),
        F.col("a.refusal").alias("error"),
    )
    return rounded(X.scenario_verdict(cells), "mean_reduction")


@query("trial_medians", f"""{RESULTS}, m AS (SELECT stale_ratio, median(latency_s) FILTER (arm = 'baseline') AS la, median(latency_s) FILTER (arm = 'treated') AS lb,
  median(input_tokens) FILTER (arm = 'baseline') AS ia, median(input_tokens) FILTER (arm = 'treated') AS ib FROM results GROUP BY stale_ratio)
SELECT stale_ratio, round(la, 6) AS latency_s_a, round(lb, 6) AS latency_s_b, ia AS input_tokens_a, ib AS input_tokens_b,
  round(100.0 * (1 - lb / la), 6) AS latency_s_reduction_pct, round(100.0 * (1 - ib / ia), 6) AS input_tokens_reduction_pct FROM m""")
def trial_medians(spark: SparkSession, sf: str) -> DataFrame:
    out = X.trial_medians(results(spark, sf), ["stale_ratio"], ["latency_s", "input_tokens"])
    return rounded(out, "latency_s_a", "latency_s_b", "latency_s_reduction_pct", "input_tokens_reduction_pct")


@query("cost_matrix", f"""{PAIRS}, t AS (SELECT count(DISTINCT task) AS tasks, sum(ain) AS ia, sum(bin) AS ib FROM pairs WHERE rep = 0)
SELECT model, tier, round(ia * 3 / 1e6 * price_in + tasks * 3 * 400 / 1e6 * price_out, 6) AS usd_a,
  round(ib * 3 / 1e6 * price_in + tasks * 3 * 400 / 1e6 * price_out, 6) AS usd_b,
  round((ia + ib) * 3 / 1e6 * price_in + 2 * tasks * 3 * 400 / 1e6 * price_out, 6) AS usd_total FROM t, roster""")
def cost_matrix(spark: SparkSession, sf: str) -> DataFrame:
    per_task = pairs(spark, sf).filter("rep = 0").groupBy("task").agg(
        F.sum("a.input_tokens").alias("ia"), F.sum("b.input_tokens").alias("ib")
    )
    totals = per_task.agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("ia").alias("input_a"), F.sum("ib").alias("input_b")
    )
    out = X.cost_matrix(totals, dims.roster(spark), reps=3, output_per_call=400)
    return rounded(out, "usd_a", "usd_b", "usd_total")


@query("unpriced_models", f"""{PAIRS} SELECT DISTINCT p.model FROM pairs p LEFT JOIN (SELECT * FROM roster WHERE model NOT IN ('gpt-mini', 'gpt-5.5')) r USING (model)
WHERE r.tier IS NULL""")
def unpriced_models(spark: SparkSession, sf: str) -> DataFrame:
    listed = dims.roster(spark, [r for r in dims.ROSTER if r[0] not in ("gpt-mini", "gpt-5.5")])
    return X.unpriced_models(pairs(spark, sf), listed)


@query("first_tasks_and_reps", f"""{RESULTS}, t AS (SELECT DISTINCT task FROM results ORDER BY task LIMIT 3)
SELECT task, arm, count(*) AS rows_in, sum(input_tokens)::BIGINT AS input_tokens FROM results JOIN t USING (task) WHERE rep < 2 GROUP BY ALL""")
def first_tasks_and_reps(spark: SparkSession, sf: str) -> DataFrame:
    chosen = X.first_tasks(results(spark, sf), 3, 2)
    return chosen.groupBy("task", "arm").agg(
        F.count(F.lit(1)).alias("rows_in"), F.sum("input_tokens").alias("input_tokens")
    )


@query("signed_ranks", f"""{PAIRS}, d AS (SELECT model, abs(ain - bin) AS diff FROM pairs WHERE ain <> bin),
r AS (SELECT model, diff, rank() OVER w + (count(*) OVER (PARTITION BY model, diff) - 1) / 2.0 AS avg_rank FROM d WINDOW w AS (PARTITION BY model ORDER BY diff))
SELECT model, diff, count(*) AS ties, any_value(avg_rank)::DOUBLE AS avg_rank FROM r GROUP BY model, diff""")
def signed_ranks(spark: SparkSession, sf: str) -> DataFrame:
    diffs = pairs(spark, sf).select("model", F.abs(F.col("a.input_tokens") - F.col("b.input_tokens")).alias("diff"))
    return X.average_ranks(diffs.filter("diff <> 0"), ["model"], "diff")


WILCOXON = f"""{PAIRS}, d AS (SELECT model, bin, ain - bin AS d, abs(ain - bin) AS ad FROM pairs),
sz AS (SELECT model, count(*) AS n_pairs, count(*) >= 2 AND NOT bool_and(abs(d) <= 1e-8 + 1e-5 * bin) AS ok FROM d GROUP BY model),
r AS (SELECT model, d, ad, rank() OVER (PARTITION BY model ORDER BY ad) + (count(*) OVER (PARTITION BY model, ad) - 1) / 2.0 AS rk FROM d WHERE d <> 0),
tie AS (SELECT model, sum(t * t * t - t) AS ties FROM (SELECT model, ad, count(*)::DOUBLE AS t FROM r GROUP BY model, ad) GROUP BY model),
s AS (SELECT model, count(*) AS n, least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0))::DOUBLE AS w FROM r GROUP BY model),
z AS (SELECT model, n_pairs, coalesce(n, 0) AS n, CASE WHEN ok THEN w END AS w,
        CASE WHEN ok THEN (w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0) END AS z
      FROM sz LEFT JOIN s USING (model) LEFT JOIN tie USING (model))"""


@query("wilcoxon", f"{WILCOXON} SELECT model, n_pairs, n, w AS statistic, round(z, 6) AS z FROM z")
def wilcoxon(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.wilcoxon(pairs(spark, sf)).drop("p_value"), "z")


ERFC = """(2 / sqrt(pi()) * list_sum(list_transform(range(0, 4001), lambda i: exp(-pow(x + i / 500.0, 2)) * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)) / 1500.0)"""


@query("wilcoxon_p_values", f"""{WILCOXON}, subsets AS (
  WITH RECURSIVE c(n, c) AS (SELECT 0, [1.0::DOUBLE] UNION ALL
    SELECT n + 1, list_transform(range(0, (n + 1) * (n + 2) // 2 + 1), lambda s: coalesce(c[s + 1], 0) + CASE WHEN s > n THEN coalesce(c[s - n], 0) ELSE 0 END) FROM c WHERE n < 50)
  SELECT * FROM c),
p AS (SELECT z.model, z.n, w, z, ties = 0 AND z.n = n_pairs AND z.n <= 50 AS exact, abs(z) / sqrt(2) AS x FROM z LEFT JOIN tie USING (model))
SELECT model, round(CASE WHEN w IS NULL THEN NULL WHEN exact THEN least(1.0, 2 * list_sum(c[1:w::BIGINT + 1]) / pow(2, p.n)) ELSE least(1.0, {ERFC}) END, 6) AS p_value
FROM p LEFT JOIN subsets USING (n)""")
def wilcoxon_p_values(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.wilcoxon(pairs(spark, sf)).select("model", "p_value"), "p_value")


def reduction_values(spark: SparkSession, sf: str) -> DataFrame:
    frame = pairs(spark, sf)
    return frame.select("model", X.input_reduction_pct(frame).alias("reduction_pct"))


@query("bootstrap_mean_ci", f"""{PAIRS} SELECT model, {mean_interval_sql("red").format(low="ci_low", high="ci_high")}
FROM (SELECT *, avg(red) OVER (PARTITION BY model) AS mu FROM pairs) GROUP BY model""")
def bootstrap_mean_ci(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.bootstrap_ci(reduction_values(spark, sf), ["model"], "reduction_pct"), "ci_low", "ci_high")


@query("bootstrap_median_ci", f"""{PAIRS}, o AS (SELECT model, red, row_number() OVER (PARTITION BY model ORDER BY red) AS r, count(*) OVER (PARTITION BY model) AS n FROM pairs),
chance AS (
  SELECT model, n, r, m, CASE WHEN r = n THEN 1.0 ELSE sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(r / n) + (n - k) * ln(1 - r / n + CASE WHEN r = n THEN 1 ELSE 0 END))) END AS p
  FROM (SELECT DISTINCT model, n, r, unnest([(n + 1) // 2, n // 2 + 1]) AS m FROM o), generate_series(0, 100000) AS g(k) WHERE k BETWEEN m AND n GROUP BY model, n, r, m),
limits AS (SELECT model, m, min(r) FILTER (p >= 0.025) AS low, min(r) FILTER (p >= 0.975) AS high FROM chance GROUP BY model, m)
SELECT model, round((min(a.red) + max(a.red)) / 2, 6) AS ci_low, round((min(b.red) + max(b.red)) / 2, 6) AS ci_high
FROM limits JOIN o a USING (model) JOIN o b USING (model) WHERE a.r = low AND b.r = high GROUP BY model""")
def bootstrap_median_ci(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.bootstrap_ci(reduction_values(spark, sf), ["model"], "reduction_pct", statistic="median"), "ci_low", "ci_high")


def cached_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Per-call rows of the four arms: reps are calls, writes cost 1.25 and reads 0.1 of the input price."""
    frame = pairs(spark, sf)
    short = F.col("task") != "task-4"
    arms = F.array(
        *[
            F.struct(F.lit(arm).alias("arm"), F.lit(cache).alias("cache"), F.col(f"{side}.input_tokens").alias("prompt_tokens"),
                     F.col(f"{side}.output_tokens").alias("output_tokens"))
            for side, arm in (("a", X.BASELINE), ("b", X.TREATED))
            for cache in (True, False)
        ]
    )
    calls = frame.select("model", "task", F.col("rep").alias("call_index"), F.explode(arms).alias("c")).select(
        "model", "task", "call_index", "c.*"
    )
    calls = calls.filter(short | F.col("cache") | (F.col("arm") == X.BASELINE)).join(
        dims.small(dims.roster(spark)), "model"
    )
    rate = F.when(~F.col("cache"), 1.0).when(F.col("call_index") == 0, 1.25).otherwise(0.1)
    written = F.col("cache") & (F.col("call_index") == 0) & (F.col("prompt_tokens") >= 40)
    cost = F.col("prompt_tokens") / 1e6 * F.col("price_in") * rate + F.col("output_tokens") / 1e6 * F.col("price_out") * 0.01
    read = F.col("cache") & (F.col("call_index") > 0)
    return calls.select(
        "model",
        "task",
        "arm",
        "cache",
        "call_index",
        "prompt_tokens",
        "output_tokens",
        F.round(cost, 9).alias("cost_usd"),
        F.when(written, F.col("prompt_tokens")).otherwise(0).alias("cache_write_tokens"),
        F.when(read, F.col("prompt_tokens")).otherwise(0).alias("cache_read_tokens"),
    )


CALLS = f"""{PAIRS}, four AS (
  SELECT model, task, rep AS call_index, 'baseline' AS arm, c AS cache, ain AS prompt_tokens, aout AS output_tokens FROM pairs, (VALUES (TRUE), (FALSE)) v(c)
  UNION ALL SELECT model, task, rep, 'treated', c, bin, bout FROM pairs, (VALUES (TRUE), (FALSE)) v(c)),
calls AS (
  SELECT model, task, arm, cache, call_index, prompt_tokens, output_tokens,
    round(prompt_tokens / 1e6 * price_in * CASE WHEN NOT cache THEN 1.0 WHEN call_index = 0 THEN 1.25 ELSE 0.1 END::DOUBLE
      + output_tokens / 1e6 * price_out * 0.01::DOUBLE, 9) AS cost_usd,
    CASE WHEN cache AND call_index = 0 AND prompt_tokens >= 40 THEN prompt_tokens ELSE 0 END AS cache_write_tokens,
    CASE WHEN cache AND call_index > 0 THEN prompt_tokens ELSE 0 END AS cache_read_tokens
  FROM four JOIN roster USING (model) WHERE task <> 'task-4' OR cache OR arm = 'baseline'),
sessions AS (
  SELECT model, task, arm, cache, count(*) AS warmup, sum(cost_usd) AS session_cost_usd, bool_or(cache_write_tokens > 0) AS cacheable,
    max(cost_usd) FILTER (call_index = 0) AS cold_cost_usd, max(cost_usd) FILTER (call_index = 1) AS warm_cost_usd,
    max(prompt_tokens) FILTER (call_index = 0) AS prompt_tokens FROM calls GROUP BY ALL),
cells AS (
  SELECT model, task, {', '.join(f"max(session_cost_usd) FILTER (arm = '{a}' AND cache = {c}) AS {n}_cost, max(cold_cost_usd) FILTER (arm = '{a}' AND cache = {c}) AS {n}_cold, max(warm_cost_usd) FILTER (arm = '{a}' AND cache = {c}) AS {n}_warm, bool_or(cacheable) FILTER (arm = '{a}' AND cache = {c}) AS {n}_able" for n, a, c in CS.CELLS)}
  FROM sessions GROUP BY model, task),
study AS (
  SELECT model, task, bc_cost >= 5e-4 AS informative, 100.0 * (bc_cost - mc_cost) / bc_cost AS saving, mc_able AS cacheable,
    CASE WHEN bc_warm > 0 AND mc_warm > 0 AND round(bc_warm - mc_warm, 9) < 0 THEN
      greatest(ceil(round(round(mc_cold - bc_cold, 9) / round(bc_warm - mc_warm, 9), 9) + 1), 1)::BIGINT END AS k
  FROM cells WHERE bc_cost IS NOT NULL AND bn_cost IS NOT NULL AND mc_cost IS NOT NULL AND mn_cost IS NOT NULL)"""


@query("cached_sessions", f"""{CALLS} SELECT model, task, arm, cache, warmup, round(session_cost_usd, 9) AS session_cost_usd, cacheable,
  cold_cost_usd, warm_cost_usd, prompt_tokens FROM sessions""")
def cached_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(CS.sessions_from_calls(cached_calls(spark, sf)), "session_cost_usd", places=9)


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return CS.pivot_cells(CS.sessions_from_calls(cached_calls(spark, sf)))


@query("skipped_cells", f"""{CALLS} SELECT model, task, concat_ws('|', CASE WHEN bc_cost IS NULL THEN 'bc' END, CASE WHEN bn_cost IS NULL THEN 'bn' END,
  CASE WHEN mc_cost IS NULL THEN 'mc' END, CASE WHEN mn_cost IS NULL THEN 'mn' END) AS missing FROM cells
WHERE bc_cost IS NULL OR bn_cost IS NULL OR mc_cost IS NULL OR mn_cost IS NULL""")
def skipped_cells(spark: SparkSession, sf: str) -> DataFrame:
    return CS.skipped(cells(spark, sf)).withColumn("missing", F.array_join("missing", "|"))


@query("cache_crossover", f"""{CALLS} SELECT model, task, informative, round(saving, 6) AS saving_pct, cacheable, k FROM study""")
def cache_crossover(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(CS.study_cells(cells(spark, sf)), "saving_pct")


STUDY_AGGS = """count(*) FILTER (informative) AS cells, count(*) FILTER (NOT informative) AS excluded,
  round(median(saving) FILTER (informative), 6) AS median_saving_pct, round(min(saving) FILTER (informative), 6) AS min_saving_pct,
  round(max(saving) FILTER (informative), 6) AS max_saving_pct, count(*) FILTER (informative AND cacheable) AS cacheable_cells,
  count(*) FILTER (informative AND k IS NULL) AS never_crossed, floor(median(k) FILTER (informative))::BIGINT AS median_k,
  min(k) FILTER (informative) AS min_k, max(k) FILTER (informative) AS max_k"""


@query("cache_study_summary", f"{CALLS} SELECT coalesce(model, 'pooled') AS model, {STUDY_AGGS} FROM study GROUP BY GROUPING SETS ((model), ())")
def cache_study_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = rounded(CS.study_summary(cells(spark, sf)), "median_saving_pct", "min_saving_pct", "max_saving_pct")
    return out.withColumn("model", F.coalesce("model", F.lit("pooled")))


@query("cache_cost_curve", f"""{CALLS}, m AS (SELECT model, median(bc_cold) AS bcc, median(bc_warm) AS bcw, median(mc_cold) AS mcc, median(mc_warm) AS mcw
  FROM cells WHERE bc_cost >= 5e-4 AND bc_warm IS NOT NULL AND mc_warm IS NOT NULL GROUP BY model)
SELECT model, k, round(bcc + (k - 1) * bcw, 10) AS usd_a, round(mcc + (k - 1) * mcw, 10) AS usd_b FROM m, range(1, 31) r(k)""")
def cache_cost_curve(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(CS.cost_curve(cells(spark, sf)), "usd_a", "usd_b", places=10)


@query("cache_use", f"""{CALLS} SELECT arm, sum(cache_read_tokens)::BIGINT AS cache_read, sum(cache_write_tokens)::BIGINT AS cache_write,
  sum(prompt_tokens - cache_read_tokens - cache_write_tokens)::BIGINT AS uncached_in,
  round(sum(cache_read_tokens) / sum(prompt_tokens), 6) AS hit_rate FROM calls GROUP BY arm""")
def cache_use(spark: SparkSession, sf: str) -> DataFrame:
    from palimpsest.operators import audit

    calls = cached_calls(spark, sf).select(
        "arm",
        F.col("cache_read_tokens").alias("cache_read"),
        F.col("cache_write_tokens").alias("cache_write"),
        (F.col("prompt_tokens") - F.col("cache_read_tokens") - F.col("cache_write_tokens")).alias("uncached_in"),
    )
    return rounded(audit.cache_use(calls, ["arm"]), "hit_rate")


@query("billed_cost", f"""{CALLS} SELECT arm, cache, count(*) AS calls, round(sum((greatest(prompt_tokens - cache_read_tokens - cache_write_tokens, 0) * 2.0
  + cache_write_tokens * 2.5 + cache_read_tokens * 0.2 + output_tokens * 10.0) / 1e6), 6) AS billed_usd FROM calls GROUP BY ALL""")
def billed_cost(spark: SparkSession, sf: str) -> DataFrame:
    calls = cached_calls(spark, sf).withColumnsRenamed(
        {"prompt_tokens": "input_tokens", "cache_read_tokens": "cache_read", "cache_write_tokens": "cache_write"}
    )
    return rounded(CS.billed_cost(calls, ["arm", "cache"]), "billed_usd")


@query("call_costs", f"""{RESULTS}, roster(model, price_in, price_out) AS (VALUES {', '.join(f"('{m}', {i}::DOUBLE, {o}::DOUBLE)" for m, _, i, o in dims.ROSTER[:6])})
SELECT model, arm, round(sum(CASE WHEN rep % 2 = 0 THEN cost_usd ELSE input_tokens / 1e6 * coalesce(price_in, 1.0)
  + output_tokens / 1e6 * coalesce(price_out, 3.0) END), 6) AS cost_usd FROM results LEFT JOIN roster USING (model) GROUP BY ALL""")
def call_costs(spark: SparkSession, sf: str) -> DataFrame:
    listed = dims.roster(spark, dims.ROSTER[:6]).drop("tier")
    rows = results(spark, sf).join(dims.small(listed), "model", "left")
    reported = F.when(F.col("rep") % 2 == 0, F.col("cost_usd"))
    cost = CS.call_cost(reported, F.col("input_tokens"), F.col("output_tokens"), F.col("price_in"), F.col("price_out"))
    return rounded(rows.groupBy("model", "arm").agg(F.sum(cost).alias("cost_usd")), "cost_usd")


def growing_rows(spark: SparkSession, sf: str) -> DataFrame:
    sessions = long_signals(spark, sf)
    steps = replay.replay_steps(sessions.rows, sessions.config(), base=4, chunk=6, steps=8)

    def arm(tokens: str) -> DataFrame:
        return steps.select(
            F.when(F.col("session_id") % 2 == 0, "claude-opus").otherwise("claude-haiku").alias("model"),
            F.col("session_id").alias("task"),
            "step",
            "history_turns",
            F.col(tokens).alias("prompt_tokens"),
            (F.col(tokens) / 1e6 * 5.0 + 0.001).alias("cost_usd"),
        )

    return X.both_arms(arm("tokens_before"), arm("tokens_after"))


GROWING = f"""WITH {{long}}, sized AS (SELECT *, {{signal}} AS signal, {{tokens}} AS tok FROM long),
steps AS (SELECT session_id, step, least(4 + (step - 1) * 6, max(n)) AS k FROM sized, range(1, 9) r(step) GROUP BY session_id, step),
st AS (SELECT t.session_id, t.step, t.k, sum(tok) AS tb, coalesce(sum(tok) FILTER ({{alive}}), 0) AS ta
       FROM steps t JOIN sized s ON s.session_id = t.session_id AND s.pos < t.k GROUP BY ALL),
g AS (SELECT CASE WHEN session_id % 2 = 0 THEN 'claude-opus' ELSE 'claude-haiku' END AS model, arm, step, k,
        CASE WHEN arm = 'baseline' THEN tb ELSE ta END AS prompt_tokens FROM st, (VALUES ('baseline'), ('treated')) v(arm)),
med AS (SELECT model, arm, step, median(prompt_tokens / 1e6 * 5.0 + 0.001) AS median_cost, median(prompt_tokens) AS median_tokens,
          max(k) AS history_turns FROM g GROUP BY ALL),
run AS (SELECT *, sum(median_cost) OVER (PARTITION BY model, arm ORDER BY step) AS cumulative_cost FROM med)"""


def growing_sql() -> str:
    from palimpsest.plans import sqltext as S

    return GROWING.format(long=S.LONG, signal=S.ROLE_SIGNAL, tokens=S.TOKENS, alive=S.alive("s.signal", "k - 1 - s.pos"))


@query("growing_medians", f"""{growing_sql()} SELECT model, arm, step, round(median_cost, 8) AS median_cost, median_tokens, history_turns,
  round(cumulative_cost, 8) AS cumulative_cost FROM run""")
def growing_medians(spark: SparkSession, sf: str) -> DataFrame:
    medians = CS.step_medians(growing_rows(spark, sf))
    return rounded(CS.cumulative_costs(medians), "median_cost", "cumulative_cost", places=8)


@query("growing_summary", f"""{growing_sql()}, e AS (SELECT model, max(step) AS steps,
  max(cumulative_cost) FILTER (arm = 'baseline') AS ua, max(cumulative_cost) FILTER (arm = 'treated') AS ub,
  arg_max(median_tokens, step) FILTER (arm = 'baseline') AS ta, arg_max(median_tokens, step) FILTER (arm = 'treated') AS tb FROM run GROUP BY model)
SELECT model, steps, round(ua, 8) AS usd_a, round(ub, 8) AS usd_b, ta AS last_tokens_a, tb AS last_tokens_b,
  round(100.0 * (1 - ub / ua), 6) AS saved_pct, round(ta / tb, 6) AS token_ratio FROM e""")
def growing_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = CS.growing_summary(CS.step_medians(growing_rows(spark, sf)))
    return rounded(rounded(out, "usd_a", "usd_b", places=8), "saved_pct", "token_ratio")


def counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("arm", "model").agg(
        F.count(F.lit(1)).alias("rows_in"), F.sum("input_tokens").alias("input_tokens"), F.count_if("success").alias("successes")
    )


COUNTED = f"""{RESULTS} SELECT arm, model, count(*) AS rows_in, sum(input_tokens)::BIGINT AS input_tokens, count(*) FILTER (success) AS successes
FROM results GROUP BY ALL"""


@query("experiment_row_scan", COUNTED)
def experiment_row_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows written as JSON lines and read back without error rows."""
    path = scratch(spark, "results")
    raw_results(spark, sf).write.json(path)
    return counted(read_results(spark, path))


@query("experiment_summary_scan", COUNTED)
def experiment_summary_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Result rows embedded in summary documents, one per task and model."""
    path = scratch(spark, "summaries")
    rows = raw_results(spark, sf)
    documents = rows.groupBy("task", "model").agg(F.collect_list(F.struct(*rows.columns)).alias("results"))
    documents.select(F.to_json(F.struct("results")).alias("value")).write.text(path)
    return counted(read_summary(spark, path, wholetext=False))
