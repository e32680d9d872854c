from __future__ import annotations

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import dims
from palimpsest.functions import stats
from palimpsest.operators import cache_study as CS
from palimpsest.operators import experiment as X
from palimpsest.operators.ranks import ranks
from palimpsest.operators.selection import exact_medians
from palimpsest.sources import experiment_rows as E

ROW = "ingest_seq BIGINT, model STRING, task STRING, rep BIGINT, arm STRING, input_tokens BIGINT, output_tokens BIGINT, success BOOLEAN, stale_ratio STRING"


def pairs_of(spark, values, model="claude-opus"):
    rows = []
    for i, (a, b) in enumerate(values):
        rows += [(2 * i, model, f"t{i}", 0, "baseline", a, 10, True, "high"), (2 * i + 1, model, f"t{i}", 0, "treated", b, 8, i % 2 == 0, "high")]
    return X.pair_arms(spark.createDataFrame(rows, ROW))


def test_pairs_need_both_arms_and_take_the_latest(spark):
    rows = [
        (0, "m", "t", 0, "baseline", 100, 1, True, "low"), (1, "m", "t", 0, "treated", 50, 1, False, "low"),
        (2, "m", "t", 0, "treated", 40, 1, True, "low"), (3, "m", "u", 0, "baseline", 9, 1, True, "low"),
    ]
    got = X.pair_arms(spark.createDataFrame(rows, ROW)).collect()
    assert len(got) == 1 and got[0].b.input_tokens == 40 and got[0].b.success
    named = spark.createDataFrame(rows, ROW).withColumn("arm", F.when(F.col("arm") == "treated", "lean").otherwise("full"))
    assert X.pair_arms(named, arms=("full", "lean")).count() == 1


def test_report_floors_and_zero_baseline(spark):
    report = X.model_report(pairs_of(spark, [(0, 0), (100, 300)]), dims.roster(spark)).collect()[0]
    assert report.mean_reduction_pct == -100.0 and report.wh_saved_mid == 0.0 and report.tokens_saved == -196
    assert X.unpriced_models(pairs_of(spark, [(1, 1)], "odd"), dims.roster(spark)).collect()[0].model == "odd"


def exact_p(diffs):
    ranks = {v: i + 1 for i, v in enumerate(sorted(abs(d) for d in diffs))}
    plus = sum(ranks[abs(d)] for d in diffs if d > 0)
    n = len(diffs)
    w = min(plus, n * (n + 1) // 2 - plus)
    hits = sum(sum(r for r, s in zip(range(1, n + 1), signs) if s) <= w for signs in itertools.product([0, 1], repeat=n))
    return w, min(1.0, 2 * hits / 2**n)


def test_wilcoxon_exact(spark):
    diffs = [5, -1, 7, 8, -2, 11, 13, 4, 3]
    row = X.wilcoxon(pairs_of(spark, [(100 + d, 100) for d in diffs])).collect()[0]
    w, p = exact_p(diffs)
    assert row.statistic == w and row.p_value == pytest.approx(p)


def test_wilcoxon_with_ties_and_zeros(spark):
    diffs = [1, 1, -1, 2, 2, 3, 0, 0, -4, 5, 5, 5, 6]
    row = X.wilcoxon(pairs_of(spark, [(100 + d, 100) for d in diffs])).collect()[0]
    real = [d for d in diffs if d]
    size = sorted(abs(d) for d in real)
    rank = {v: np.mean([i + 1 for i, x in enumerate(size) if x == v]) for v in set(size)}
    plus, minus = sum(rank[d] for d in real if d > 0), sum(rank[-d] for d in real if d < 0)
    n, ties = len(real), sum(c**3 - c for c in (size.count(v) for v in set(size)))
    z = (min(plus, minus) - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    assert (row.n_pairs, row.n, row.statistic) == (13, n, min(plus, minus))
    assert row.z == pytest.approx(z) and row.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-6)


def test_wilcoxon_refuses_small_or_equal_groups(spark):
    assert X.wilcoxon(pairs_of(spark, [(5, 1)])).collect()[0].p_value is None
    assert X.wilcoxon(pairs_of(spark, [(5, 5), (6, 6), (7, 7)])).collect()[0].statistic is None
    assert X.wilcoxon(pairs_of(spark, [(10**7, 10**7 + 1), (10**7, 10**7 + 2)])).collect()[0].statistic is None
    many = X.wilcoxon(pairs_of(spark, [(1000 + 7 * i, 100) for i in range(90)])).collect()[0]
    assert many.statistic == 0.0 and many.p_value == pytest.approx(1.7e-16, rel=0.05)


def test_error_function(spark):
    xs = [-3.0, -0.5, 0.0, 0.1, 1.0, 2.5, 6.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x DOUBLE").select(stats.erfc(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], rel=2e-7)


@pytest.mark.parametrize("statistic", ["mean", "median"])
def test_bootstrap(spark, statistic):
    rng = random.Random(3)
    groups = {"a": [rng.gauss(80, 5) for _ in range(90)], "b": [rng.random() ** 3 * 100 for _ in range(45)], None: [rng.gauss(0, 1) for _ in range(400)], "one": [4.0], "same": [2.0] * 9}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "g STRING, v DOUBLE").repartition(3)
    got = {r.g: (r.ci_low, r.ci_high) for r in X.bootstrap_ci(df, ["g"], "v", statistic=statistic).collect()}
    assert set(got) == set(groups) and got["one"] == (4.0, 4.0) and got["same"] == (2.0, 2.0)
    for g in ("a", "b", None):
        draws = np.random.default_rng(7).choice(np.array(groups[g]), size=(20_000, len(groups[g])))
        est = draws.mean(axis=1) if statistic == "mean" else np.median(draws, axis=1)
        want = np.percentile(est, [2.5, 97.5])
        assert got[g] == pytest.approx(tuple(want), abs=(0.03 if statistic == "mean" else 0.08) * (want[1] - want[0]))
    assert X.bootstrap_ci(df.limit(0), ["g"], "v", statistic=statistic).count() == 0


@pytest.mark.parametrize("n", [1024, 1025, 2_000_000])
def test_median_interval_of_every_size(spark, n):
    """Within one hundredth of the width that the order statistics give."""
    df = spark.range(n).select(F.lit(0).alias("g"), F.col("id").cast("double").alias("v"))
    r = X.bootstrap_ci(df, ["g"], "v", statistic="median").collect()[0]
    half = stats.Z975 * math.sqrt(n) / 2
    assert (r.ci_low, r.ci_high) == pytest.approx(((n - 1) / 2 - half, (n - 1) / 2 + half), abs=max(0.6, 0.01 * half))


def test_binomial_tails():
    for n, m, x in [(1, 1, 0.3), (7, 4, 0.5), (50, 20, 0.31), (300, 151, 0.55), (5, 0, 0.2), (5, 6, 0.2)]:
        want = sum(math.comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(m, n + 1))
        assert stats.binomial_tail(n, m, x) == pytest.approx(want, rel=1e-10)
    for n in (1, 2, 3, 10, 101):
        for m in ((n + 1) // 2, n // 2 + 1):
            for p in (0.025, 0.975):
                assert stats.rank_of_middle(n, m, p) == min(r for r in range(1, n + 1) if stats.binomial_tail(n, m, r / n) >= p)


def test_ranks_over_ranges(spark):
    """The same ranks however the values are dealt to ranges; no window takes in a whole group."""
    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", "hot", "cold", None]), rng.randint(0, 400)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "g STRING, v INT")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ranks(df, ["g"], "v")
        got = {(r.g, r.v): (r.ties, r.below) for r in found.rows.collect()}
        assert found.parts.count() > 4
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("hot", "cold", None):
        own = [v for k, v in rows if k == g]
        assert {v: got[g, v] for v in set(own)} == {v: (own.count(v), sum(x < v for x in own)) for v in set(own)}
    plan = found.rows._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "windowspecdefinition" in line]
    assert windows and all("part" in line for line in windows)
    wanted = spark.createDataFrame([(None, "a", 1), ("hot", "b", 1000)], "g STRING, name STRING, rank BIGINT")
    hot = sorted(v for k, v in rows if k == "hot")
    assert {(r.g, r.name): r.v for r in found.at(wanted).collect()} == {(None, "a"): min(v for k, v in rows if k is None), ("hot", "b"): hot[999]}


def test_medians_of_all_sizes(spark):
    rng = random.Random(6)
    rows = [(g, rng.choice([rng.random() * 100, float(rng.randint(0, 5))])) for g in range(4) for _ in range(rng.choice([1, 2, 501, 800]))]
    df = spark.createDataFrame(rows, "g INT, v DOUBLE")
    want = {g: float(np.median([v for k, v in rows if k == g])) for g in range(4)}
    two = {"m": F.col("v"), "half": F.when(F.col("g") > 0, F.col("v") / 2)}
    got = {r.g: (r.m, r.half, r.n) for r in exact_medians(df, ["g"], two, also=[F.count("*").alias("n")]).collect()}
    assert {g: m for g, (m, _, _) in got.items()} == pytest.approx(want)
    assert {g: h for g, (_, h, _) in got.items() if g} == pytest.approx({g: m / 2 for g, m in want.items() if g}) and got[0][1] is None
    assert sum(n for _, _, n in got.values()) == len(rows)
    assert exact_medians(df.limit(0), ["g"], two).count() == 0


def test_crossover_fixture(spark):
    rows = [(0.010, 0.001, 0.003, 0.002, 8), (0.010, 0.002, 0.003, 0.001, None), (0.002, 0.001, 0.003, 0.002, 1), (0.01, None, 0.003, 0.002, None)]
    df = spark.createDataFrame(rows, "cb DOUBLE, wb DOUBLE, cm DOUBLE, wm DOUBLE, want BIGINT")
    got = df.withColumn("k", CS.crossover(F.col("cb"), F.col("wb"), F.col("cm"), F.col("wm"))).collect()
    assert [r.k for r in got] == [r.want for r in got]


def test_study_excludes_free_sessions(spark):
    rows = []
    for task, base in (("t0", 0.02), ("t1", 0.0001), ("t2", 0.01)):
        for arm, cache in itertools.product(("baseline", "treated"), (True, False)):
            if task == "t2" and arm == "treated" and not cache:
                continue
            cost = base if arm == "baseline" else base / 2
            rows += [("m", task, arm, cache, i, cost / (1 + i), 10, 5 if cache and i == 0 else 0) for i in range(2)]
    calls = spark.createDataFrame(rows, "model STRING, task STRING, arm STRING, cache BOOLEAN, call_index INT, cost_usd DOUBLE, prompt_tokens BIGINT, cache_write_tokens BIGINT")
    cells = CS.pivot_cells(CS.sessions_from_calls(calls))
    summary = {r.model: r for r in CS.study_summary(cells).collect()}
    assert (summary["m"].cells, summary["m"].excluded, summary["m"].cacheable_cells) == (1, 1, 1)
    assert summary[None].median_saving_pct == pytest.approx(50.0)
    assert [(r.task, r.missing) for r in CS.skipped(cells).collect()] == [("t2", ["mn"])]
    curve = {r.k: r for r in CS.cost_curve(cells.filter("task = 't0'"), 3).collect()}
    assert curve[3].usd_a == pytest.approx(0.02 + 2 * 0.01)


def test_scans_of_result_files(spark, tmp_path):
    rows = [dict(task="t", model="m", arm="baseline", input_tokens=1), dict(task="t", model="m", error="x"), dict(task="t", model="m", mock=True)]
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n\nnot-json\n")
    assert [r.rep for r in E.read_results(spark, str(tmp_path / "r.jsonl")).collect()] == [0]
    assert E.read_results(spark, str(tmp_path / "r.jsonl"), drop_mock=False).count() == 2
    for i, document in enumerate((rows, {"rows": rows}, {"rows": [], "results": rows}, {"raw": rows})):
        (tmp_path / f"s{i}.json").write_text(json.dumps(document))
        assert E.read_summary(spark, str(tmp_path / f"s{i}.json")).count() == 1


def test_counts_of_answers(spark):
    rows = [(True, 5), (True, 500), (False, 500)]
    df = spark.createDataFrame([("a" if f else None, o) for f, o in rows], "refusal STRING, output_tokens INT").withColumn("arm", F.lit("x"))
    r = X.refusals(df, ["arm"], F.col("output_tokens") > 10).collect()[0]
    assert (r.hard_refusals, r.soft_flags, r.useful_answers) == (1, 1, 2)
    p = X.parity(pairs_of(spark, [(10, 5)] * 4)).collect()[0]
    assert (p.both_ok, p.a_only, p.divergent) == (2, 2, 2)
