from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import brute
from palimpsest.operators import neardup as N
from palimpsest.operators import power, signals
from palimpsest.operators.components import smallest_reachable
from palimpsest.plans import registry
from palimpsest.plans import signals as _plans  # noqa: F401


def test_bus_fixture(spark):
    df = spark.createDataFrame([(0x0F, 0.9), (0x10, 0.5)], "flags INT, intensity DOUBLE").withColumn("bus", F.lit(0))
    masks = {"all": 0x0F, "one": 0x01, "off": 0x20}
    got = {r.mask_id: r.level for r in signals.sense(signals.concentrations(df), masks).collect()}
    assert got == pytest.approx({"all": 3.6, "one": 0.9, "off": 0.0})
    stats = signals.bus_stats(df).collect()[0]
    assert stats.secretions == 2 and stats.total_concentration == pytest.approx(4.1)
    narrow = signals.bus_stats(df, channels=2).collect()[0]
    assert narrow.secretions == 2 and narrow.total_concentration == pytest.approx(1.8)
    assert signals.snapshot(signals.concentrations(df, ["bus"]), ["bus"], 6).collect()[0].levels == pytest.approx([0.9] * 4 + [0.5, 0.0])
    faded = signals.dissipated(df.limit(1), F.lit(0), 1, 0.5).filter("channel = 0").collect()[0]
    assert faded.concentration == pytest.approx(0.45)


def test_highest_channel(spark):
    df = spark.createDataFrame([(-(1 << 31), 1.0)], "flags INT, intensity DOUBLE")
    assert [r.channel for r in signals.concentrations(df).collect()] == [31]
    assert signals.bus_stats(df).collect()[0].total_concentration == 1.0


def test_retention(spark):
    df = spark.createDataFrame([(d, i) for d in range(2) for i in range(10)], "day INT, i INT")
    got = signals.retained(df, ["day"], ["i"], 3)
    assert sorted((r.day, r.i) for r in got.collect()) == [(d, i) for d in range(2) for i in range(3)]


@pytest.mark.parametrize("bucket", [700_000, 10_000_000])
def test_power_fixture(spark, bucket):
    samples = spark.createDataFrame([("d", 0, 10.0), ("d", 1_000_000, 20.0), ("d", 2_000_000, 20.0), ("d", 9_000_000, 5.0)], "device STRING, t BIGINT, watts DOUBLE")
    intervals = spark.createDataFrame([("d", 0, 0, 2_000_000, 5.0), ("d", 1, 8_000_000, 9_500_000, 0.0), ("d", 2, 3_000_000, 4_000_000, 0.0), ("d", 3, 0, 2_000_000, 99.0)], "device STRING, interval_id INT, t0 BIGINT, t1 BIGINT, idle_w DOUBLE")
    got = {r.interval_id: r for r in power.interval_energy(samples, intervals, bucket_us=bucket).collect()}
    assert (got[0].joule, got[0].marginal_joule, got[0].avg_watts, got[0].samples) == (35.0, 25.0, 17.5, 3)
    assert (got[1].joule, got[1].samples) == (0.0, 1) and (got[2].joule, got[2].samples) == (0.0, 0)
    assert got[3].marginal_joule == 0.0


def signed(v):
    return v - (1 << 64) if v >= 1 << 63 else v


def frame(spark, sigs):
    return spark.createDataFrame([(i, signed(s)) for i, s in enumerate(sigs)], "item_id BIGINT, sig BIGINT")


def test_chain_fixture(spark):
    chain = [0b0000, 0b1111, 0b11111111]
    assert [r.item_id for r in N.keep_first(frame(spark, chain)).orderBy("item_id").collect()] == [0, 2]
    assert [r.item_id for r in N.keep_latest(frame(spark, chain)).orderBy("item_id").collect()] == [1, 2]


@pytest.mark.parametrize("limit", [2, 16, 512])
def test_near_duplicates_fuzz(spark, limit):
    rng = random.Random(limit)
    centres = [rng.getrandbits(64) for _ in range(6)]
    sigs = []
    for _ in range(160):
        s = rng.choice(centres + centres[:1] * 6)
        for b in rng.sample(range(64), rng.choice([0, 0, 1, 2, 3, 5])):
            s ^= 1 << b
        sigs.append(s)
    items = frame(spark, sigs)
    for threshold in (0, 2, 5):
        distinct = N.distinct_signatures(items)
        rows = N.near_pairs(distinct, threshold, limit=limit).collect()
        pairs = {(r.a_id, r.b_id): r.distance for r in rows}
        first = {s: sigs.index(s) for s in sigs}
        ids = sorted(first.values())
        want = {(a, b): bin(sigs[a] ^ sigs[b]).count("1") for a in ids for b in ids if a < b and bin(sigs[a] ^ sigs[b]).count("1") <= threshold}
        assert pairs == want and len(rows) == len(pairs)
        near = lambda i, j: bin(sigs[i] ^ sigs[j]).count("1") <= threshold
        reach = {i: i for i in range(160)}
        for _ in range(160):
            for i in range(160):
                reach[i] = min(reach[j] for j in range(160) if near(i, j))
        got = {r.item_id: (r.class_id, r.links) for r in N.near_classes(items, threshold, limit=limit).collect()}
        assert got == {i: (reach[i], sum(near(i, j) for j in range(160)) - 1) for i in range(160)}
    reps, newest = brute.leaders(sigs, 5)
    assert sorted(r.item_id for r in N.keep_first(items).collect()) == reps
    assert sorted(r.item_id for r in N.keep_latest(items).collect()) == newest
    rounds = N.clusters(items, settled=limit)
    assert sorted(r.first_id for r in rounds.filter("leader_id = first_id").collect()) == reps


def test_scopes_do_not_mix(spark):
    rows = [(g, i, signed(s)) for g in ("a", "b", None) for i, s in enumerate([0, 1, 3, 1 << 63, 0])]
    items = spark.createDataFrame(rows, "g STRING, item_id BIGINT, sig BIGINT")
    got = {(r.g, r.item_id): (r.class_id, r.links) for r in N.near_classes(items, 1, ["g"]).collect()}
    one = {0: (0, 3), 1: (0, 3), 2: (0, 1), 3: (0, 2), 4: (0, 3)}
    assert got == {(g, i): v for g in ("a", "b", None) for i, v in one.items()}
    assert N.near_classes(items.limit(0), 5, ["g"]).count() == 0


def test_no_cell_above_two_tiles(spark):
    """One dense cluster of signatures that no block tells apart, next to spread ones."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    sigs = {centre ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(1500)} | {rng.getrandbits(64) for _ in range(500)}
    signatures = N.distinct_signatures(frame(spark, sorted(sigs)))
    sizes = [r["count"] for r in N.tiles(signatures, 5, limit=64).groupBy("cell").count().collect()]
    assert max(sizes) <= 3 * 64  # two tiles, whose sizes follow from a hash
    classes = N.linked(signatures, 5, limit=64)
    small = sorted(sigs)[:: len(sigs) // 40]
    for s in small:
        want = sum(0 < bin(s ^ o).count("1") <= 5 for o in sigs)
        assert classes.filter(F.col("sig") == signed(s)).first()["links"] == want


def test_latest_takes_few_jobs(spark):
    """Chains of near-duplicates, each link near to the one before only, do not take a round per link."""
    sigs = []
    for g in range(40):
        s = (g * 0x9E3779B97F4A7C15) % (1 << 64)
        for k in range(12):
            s ^= 0b1111 << (4 * k)
            sigs.append(s)
    items = frame(spark, sigs)
    reps, newest = brute.leaders(sigs, 5)
    assert sorted(r.item_id for r in N.keep_latest(items).collect()) == newest


def test_pairs_come_once(spark):
    items = frame(spark, [0, 1, 3, 7])
    rows = N.near_pairs(N.distinct_signatures(items)).collect()
    assert len(rows) == len({(r.a_id, r.b_id) for r in rows}) == 6


def test_media_substitution(spark):
    rows = [
        ("s", 0, "media", 5, "m0", 1600, False), ("s", 1, "media", 5, "m1", 1600, False), ("s", 2, "text", None, "old", 1, False),
        ("s", 3, "media", 1 << 40, "m3", 1600, True), ("s", 4, "text", None, "new", 1, True), ("t", 0, "media", 5, "m", 1600, False),
    ]
    df = spark.createDataFrame(rows, "session_id STRING, pos BIGINT, kind STRING, sig BIGINT, text STRING, tokens BIGINT, keep BOOLEAN")
    extracts = spark.createDataFrame([("s", 1, "screen one")], "session_id STRING, pos BIGINT, extract STRING")
    got = sorted((r.session_id, r.pos, r.kind, r.tokens) for r in N.substitute_media(df, extracts, 1).collect())
    assert got == [("s", 1, "extract", 3), ("s", 3, "media", 1600), ("s", 4, "text", 1), ("t", 0, "extract", 1)]


def dense(rng, n):
    centre = rng.getrandbits(64)
    return sorted({centre ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(n)}, key=lambda s: s * 0x9E3779B97F4A7C15 % (1 << 64))


def test_large_class_lists_no_pairs(spark, monkeypatch):
    """Leaders of a class above the limit of a task come from rounds over prefixes, never from a table of its pairs."""
    monkeypatch.setattr(N, "near_pairs", None)
    sigs = dense(random.Random(7), 300)
    reps, newest = brute.leaders(sigs, 5)
    items = frame(spark, sigs)
    rows = N.clusters(items, settled=4)
    assert sorted(r.first_id for r in rows.filter("leader_id = first_id").collect()) == reps and rows.count() == len(sigs)
    assert sorted(r.item_id for r in rows.groupBy("leader_id").agg(F.max("last_id").alias("item_id")).collect()) == newest
    two = items.withColumn("g", F.lit("a")).unionByName(items.filter("item_id % 2 = 0").withColumn("g", F.lit(None).cast("string")))
    half, _ = brute.leaders(sigs[::2], 5)
    lead = N.clusters(two, scope=["g"], settled=4).filter("leader_id = first_id")
    assert sorted(r.first_id for r in lead.filter("g = 'a'").collect()) == reps
    assert sorted(r.first_id for r in lead.filter("g IS NULL").collect()) == [2 * i for i in half]


def test_dense_signatures_are_not_copied_often(spark):
    """What is written for a dense cluster grows with its rows, not with its pairs."""
    sigs = dense(random.Random(8), 4000)
    assert N.tiles(N.distinct_signatures(frame(spark, sigs)), 5).count() <= 2 * len(sigs)


def test_components_by_contraction(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(1000, i) for i in range(200, 240)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(90)]
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    ends = {n for a, b in edges if a != b for n in (a, b)}
    got = [tuple(r) for r in smallest_reachable(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()]
    assert len(got) == len(ends) and dict(got) == {n: label[n] for n in ends}
    assert smallest_reachable(spark.createDataFrame([(5, 5)], "a BIGINT, b BIGINT")).count() == 0


def test_embedding_pairs_reach_to_sixteen_signs(spark, tmp_path):
    """Small components count by their sign, and pairs reach to 16 of 64."""
    vectors = [[0.01] * 64, [-0.01] * 16 + [0.01] * 48, [0.01] * 47 + [-0.01] * 17]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id BIGINT, embedding ARRAY<FLOAT>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [tuple(r) for r in registry.QUERIES["near_embedding_pairs"](spark, str(tmp_path)).select("a_id", "b_id", "distance").collect()]
    assert got == [(0, 1, 16)]
