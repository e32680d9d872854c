from __future__ import annotations

import functools
import hashlib
import json
import uuid

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import audit as A
from palimpsest.operators import ledger as L
from palimpsest.plans import audits, registry
from palimpsest.sources import audit_log, unit_store
from palimpsest import dims

AUDIT = "seq BIGINT, deployment STRING, ts STRING, model STRING, tokens_before BIGINT, tokens_after BIGINT"
ROWS = [(0, "d", "2026-07-19T10:00:00", "m", 5000, 200), (1, "d", "2026-07-19T10:00:01", "m", 3000, 150)]
HASHES = [
    "3e4e901cfd39f76a22d091623b56b70504e44645c1e9db63a0ec8eef41de88d1",
    "06a1e2d432a8e215a680811417703273035c35a9c9bb5846f449a188537eda03",
]


def test_chain_fixture(spark):
    rows = L.chain(spark.createDataFrame(ROWS, AUDIT)).orderBy("seq").collect()
    assert [r.hash for r in rows] == HASHES and rows[0].prev_hash == "GENESIS" and rows[1].prev_hash == HASHES[0]


def test_ledger_fixture(spark):
    row = L.build_ledger(L.chain(spark.createDataFrame(ROWS, AUDIT)), grid="br", price_in=2.0).collect()[0]
    assert (row.requests, row.before, row.after, row.saved, row.input_reduction_pct) == (2, 8000, 350, 7650, 95.625)
    assert row.usd_input_avoided == pytest.approx(0.0153)
    assert [row.wh_low, row.wh_mid, row.wh_high] == pytest.approx([3.825, 6.885, 9.945])
    assert [row.gco2e_low, row.gco2e_mid, row.gco2e_high] == pytest.approx([0.3825, 0.6885, 0.9945])
    assert row.chain_head == HASHES[1]
    free = L.build_ledger(L.chain(spark.createDataFrame(ROWS, AUDIT)), price_in=0.0).collect()[0]
    assert free.usd_input_avoided is None
    with pytest.raises(ValueError):
        L.build_ledger(L.chain(spark.createDataFrame(ROWS, AUDIT)), grid="mars")


def many(spark, n=40):
    return spark.createDataFrame(
        [(i, f"d{i % 2}", f"t{i}", None if i % 7 == 0 else 'q"\\é', 100 + i, i) for i in range(n)], AUDIT
    )


def test_tampering_is_found(spark):
    chained = L.chain(many(spark)).cache()
    check = lambda df: {r.deployment: r for r in L.verify(df, block_rows=8).collect()}
    assert all(r.ok and r.first_broken is None for r in check(chained).values())
    edited = chained.withColumn("tokens_after", F.when(F.col("seq") == 12, 0).otherwise(F.col("tokens_after")))
    assert check(edited)["d0"].first_broken == 12 and check(edited)["d1"].ok
    assert check(chained.filter("seq <> 12"))["d0"].first_broken == 14
    short = check(chained.filter("seq < 38"))
    assert short["d0"].ok and short["d0"].last_hash != check(chained)["d0"].last_hash
    with pytest.raises(Exception, match="audit chain broken"):
        L.build_ledger(edited).collect()
    chained.unpersist()


def test_segments_are_tied(spark):
    chained = L.chain(many(spark), segment=F.floor(F.col("seq") / 10)).cache()
    sealed = L.seal(L.segment_heads(chained)).cache()
    check = lambda rows, heads: {r.deployment: (r.ok, r.first_broken) for r in L.verify(rows, sealed=heads, block_rows=8).collect()}
    fine, d0 = (True, None), F.col("deployment") == "d0"
    assert check(chained, sealed) == {"d0": fine, "d1": fine}
    assert not any(r.ok for r in L.verify(chained).collect())  # segments do not pass as one chain
    deleted, ended = chained.filter(~(d0 & (F.col("segment") == 1))), chained.filter(~(d0 & F.col("seq").between(16, 19)))
    assert check(deleted, sealed) == {"d0": (False, 10), "d1": fine}
    assert check(ended, sealed) == {"d0": (False, 10), "d1": fine}
    assert check(chained.filter(~d0), sealed)["d0"] == (False, 0)
    swapped = chained.withColumn("segment", F.when(F.col("segment") == 1, 2).when(F.col("segment") == 2, 1).otherwise(F.col("segment")))
    assert all(not ok for ok, _ in check(swapped, sealed).values())
    fewer = sealed.filter(~(d0 & (F.col("segment") == 1)))  # the list was shortened together with the rows
    assert check(deleted, fewer)["d0"] == (False, 20)
    for rows, heads in ((deleted, sealed), (ended, sealed), (swapped, sealed), (deleted, fewer)):
        with pytest.raises(Exception, match="audit chain broken"):
            L.build_ledger(rows, sealed=heads).collect()
    built = {r.deployment: r for r in L.build_ledger(chained, sealed=sealed).collect()}
    assert built["d0"].segments == 4 and built["d0"].requests == 20


def test_comparison_sees_a_cut_tail(spark):
    full, short = L.build_ledger(L.chain(many(spark))), L.build_ledger(L.chain(many(spark).filter("seq < 39")))
    got = {r.deployment: r for r in L.compare_ledgers(full, short).collect()}
    assert got["d0"].ok and not got["d1"].ok and not got["d1"].chain_head_ok


def test_no_saving_is_zero(spark):
    row = L.build_ledger(L.chain(spark.createDataFrame([(0, "d", "t", "m", 10, 10)], AUDIT)), price_in=1.0).collect()[0]
    assert row.saved == 0 and row.wh_high == 0.0 and row.usd_input_avoided is None


def test_audit_scan_skips_bad_lines(spark, tmp_path):
    lines = ['{"ts": "t", "model": "m", "tokens_before": 5, "tokens_after": 2}', "", "not-json", '{"tokens_before": "garbage"}', '"text"', '{"model": "x"}']
    (tmp_path / "a.json").write_text("\n".join(lines))
    rows = audit_log.read_audit(spark, str(tmp_path), sized_only=True).collect()
    assert [(r.model, r.tokens_before) for r in rows] == [("m", 5)]


def test_audit_rows_round_trip(spark, tmp_path):
    frame = many(spark).withColumns(
        {"reduction": F.lit(0.123456), "blocks_purged": F.lit(3), "held": F.col("seq") % 2 == 0, "potential_reduction": F.lit(0.2), "purged_hashes": F.array()}
    )
    rows = audit_log.audit_rows(frame, ts=F.col("ts"), model=F.col("model"), latency=F.lit(1.23456))
    path = str(tmp_path / uuid.uuid4().hex)
    audit_log.write_audit(rows, path)
    back = audit_log.read_audit(spark, path).orderBy("seq").collect()
    assert len(back) == 40 and back[0].reduction == 0.1235 and back[0].kernel_latency_us == 1.23
    assert back[0].held is True and back[1].held is None and back[1].potential_reduction is None and back[0].model == "?"


def test_ledger_document(spark, tmp_path):
    path = str(tmp_path / "ledger")
    L.write_ledger(L.build_ledger(L.chain(spark.createDataFrame(ROWS, AUDIT)), period="2026-07"), path)
    text = "".join(p.read_text() for p in (tmp_path / "ledger").glob("*.json"))
    doc = json.loads(text)
    assert doc["tokens"] == {"before": 8000, "after": 350, "saved": 7650} and doc["chain_head"] == HASHES[1]
    assert len(doc["wh_avoided"]) == 3


def test_estimates(spark):
    totals = spark.createDataFrame([("a", 1_000_000, 0), ("b", 45_868, 0), ("c", 5, 10)], "k STRING, tokens_before BIGINT, tokens_after BIGINT")
    rolled = A.rollup(totals, ["k"])
    got = {r.k: r for r in A.estimates(rolled, price_in=0.0).collect()}
    assert (got["a"].wh_low, got["a"].wh_mid, got["a"].wh_high) == pytest.approx((500.0, 900.0, 1300.0))
    assert got["b"].wh_mid == pytest.approx(41.28, abs=0.01) and got["b"].gco2e_mid == pytest.approx(18.37, abs=0.01)
    assert got["a"].usd_avoided == 0.0 and got["c"].wh_mid == 0.0 and got["c"].usd_avoided is None
    cached = A.estimates(rolled, cache_hit=0.75).filter("k = 'a'").collect()[0]
    assert cached.wh_mid == pytest.approx(900 * 0.325)
    with pytest.raises(Exception, match="must be positive"):
        A.energy_per_request(A.rollup(totals.limit(1).withColumn("tokens_before", F.lit(0)), ["k"])).collect()


def test_monitor_fixtures(spark):
    rows = [(0, "a", 5000, 200, 2, 0.96, 1.0), (1, "b", 3000, 150, 3, 0.95, 5.0), (2, "a", 1000, 500, 1, 0.5, 2.0)]
    df = spark.createDataFrame(rows, "seq BIGINT, model STRING, tokens_before BIGINT, tokens_after BIGINT, blocks_purged BIGINT, reduction DOUBLE, kernel_latency_us DOUBLE")
    total = A.session_totals(df).collect()[0]
    assert (total.tokens_before, total.tokens_after, total.blocks_purged, total.peak_reduction) == (9000, 850, 6, 0.96)
    assert {r.model: r.requests for r in A.model_totals(df).collect()} == {"a": 2, "b": 1}
    frame = df.withColumn("k", F.lit(0))
    for block_rows in (0, 2):
        last = A.rolling_stats(frame, ["k"], "seq", block_rows=block_rows).filter("seq = 2").collect()[0]
        assert (last.latency_p50, last.latency_max, last.window_rows) == (2.0, 5.0, 3)
        two = A.rolling_stats(frame, ["k"], "seq", window=2, block_rows=block_rows).filter("seq = 2").collect()[0]
        assert (two.latency_p50, two.latency_max) == (5.0, 5.0)
        curve = A.thin_curve(frame, ["k"], "seq", points=2, block_rows=block_rows).collect()
        assert sorted(r.row_no for r in curve) == [1, 2, 3]


def test_unit_store(spark, tmp_path):
    rows = [("s", 0, 0, "assistant", 'é "x"'), ("s", 0, 1, "tool", "y"), ("t", 3, 9, "assistant", 'é "x"'), ("t", 3, 10, "tool", "y"), ("t", 4, 12, "user", None)]
    purged = spark.createDataFrame(rows, "session_id STRING, unit_id BIGINT, pos BIGINT, role STRING, text STRING")
    docs = unit_store.unit_documents(purged)
    by = {(r.session_id, r.unit_id): r for r in docs.collect()}
    assert by[("s", 0)].digest == by[("t", 3)].digest
    assert json.loads(by[("t", 4)].unit) == [{"content": None, "role": "user"}]
    path = str(tmp_path / "store")
    unit_store.append_units(docs, path)
    stored = unit_store.read_units(spark, path)
    assert stored.count() == 2 and unit_store.new_units(docs, stored).count() == 0
    asked = spark.createDataFrame([(by[("s", 0)].digest,), ("0" * 64,), ("XYZ",)], "digest STRING")
    got = {r.digest: (r.status, r.unit) for r in unit_store.rehydrate(asked, stored).collect()}
    assert got[by[("s", 0)].digest] == ("found", by[("s", 0)].unit)
    assert got["0" * 64][0] == "unknown" and got["XYZ"][0] == "invalid"
    lists = {r.session_id: r.purged_hashes for r in unit_store.session_digests(docs).collect()}
    assert lists["t"] == [by[("t", 3)].digest, by[("t", 4)].digest]
    use = A.hibernation_use(unit_store.session_digests(docs)).collect()[0]
    assert (use.references, use.unique_units) == (3, 2)


def test_large_units_are_stored_in_parts(spark, tmp_path):
    rows = [("s", 0, p, "tool", f"t{p}") for p in range(3, 25)] + [("s", 1, p, "user", f"t{p}") for p in range(25, 33)] + [("t", 0, p, "user", "x") for p in range(8)]
    purged = spark.createDataFrame(rows, "session_id STRING, unit_id BIGINT, pos BIGINT, role STRING, text STRING")
    docs = unit_store.unit_documents(purged, part_rows=8)
    got = {(r.session_id, r.unit_id, r.part): r for r in docs.collect()}
    parts = [got["s", 0, k] for k in range(4)]
    assert [m["content"] for p in parts for m in json.loads(p.unit)] == [f"t{p}" for p in range(3, 25)]
    assert [x["part"] for x in json.loads(got["s", 0, None].unit)] == [p.digest for p in parts]
    assert len(json.loads(got["s", 1, None].unit)) == 8 and len(json.loads(got["t", 0, None].unit)) == 8 and len(got) == 7
    lists = {r.session_id: r.purged_hashes for r in unit_store.session_digests(docs).collect()}
    assert lists["s"] == [got["s", 0, None].digest, got["s", 1, None].digest]


def test_appends_can_be_repeated_and_shared(spark, tmp_path):
    rows = [("s", u, u, "user", f"text {u % 4}") for u in range(8)]
    docs = unit_store.unit_documents(spark.createDataFrame(rows, "session_id STRING, unit_id BIGINT, pos BIGINT, role STRING, text STRING"))
    path = str(tmp_path / "store")
    for writer, batch, part in (("a", 0, "unit_id < 4"), ("a", 0, "unit_id < 4"), ("b", 0, "unit_id >= 2"), ("a", 1, "unit_id = 7")):
        unit_store.append_units(docs.filter(part), path, writer=writer, batch=batch)
    stored = unit_store.read_units(spark, path)
    assert stored.count() == stored.select("digest").distinct().count() == 4
    assert spark.read.parquet(path).filter("writer = 'a' AND batch = 0").count() == 4


def test_dimensions(spark, tmp_path):
    (tmp_path / "roster.json").write_text(json.dumps({"budget": {"m": {"price_in": 1.0, "price_out": 2.0, "provider": "p"}}, "frontier": {"n": {"price_in": 3, "price_out": 4}}}))
    got = sorted(tuple(r) for r in dims.read_roster(spark, str(tmp_path / "roster.json")).collect())
    assert got == [("m", "budget", 1.0, 2.0), ("n", "frontier", 3.0, 4.0)]
    with pytest.raises(ValueError):
        dims.grid_factor("mars")


def test_a_shard_of_a_batch_is_one_file(spark, tmp_path):
    docs = spark.range(4000).selectExpr("id AS session_id", "0L AS unit_id", "concat('u', id) AS unit").withColumn("digest", F.sha2("unit", 256))
    path, key = str(tmp_path / "units"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        unit_store.append_units(docs, path)
    finally:
        spark.conf.unset(key)
    shards = list((tmp_path / "units").glob("writer=*/batch=*/shard=*"))
    assert len(shards) == 256 and all(len(list(s.glob("*.parquet"))) == 1 for s in shards)
    assert unit_store.read_units(spark, path).count() == 4000


def test_a_large_unit_has_the_digest_of_the_whole(spark):
    """Units in several parts next to each other, equal units cut at other places, and keys of two columns."""
    rows = [("s", "k", 0, p, "tool", f"é{p}") for p in range(3, 25)] + [("s", "k", 1, p, "user", None if p == 30 else f"t{p}") for p in range(25, 45)]
    rows += [("t", "k", 5, p - 2, "tool", f"é{p}") for p in range(3, 25)] + [("t", "l", 5, 0, "user", "x")]
    purged = spark.createDataFrame(rows, "session_id STRING, other STRING, unit_id BIGINT, pos BIGINT, role STRING, text STRING")
    whole, parted = (
        {(r.session_id, r.other, r.unit_id): r for r in unit_store.unit_documents(purged, ["session_id", "other"], part_rows=n).filter("part IS NULL").collect()}
        for n in (4096, 8)
    )
    assert {k: r.digest for k, r in parted.items()} == {k: r.digest for k, r in whole.items()} and len(whole) == 4
    assert all(r.digest == hashlib.sha256(r.unit.encode()).hexdigest() for r in whole.values())
    assert [set(x) for x in json.loads(parted["s", "k", 0].unit)] == [{"part"}] * 4 and parted["s", "k", 0].digest == parted["t", "k", 5].digest


def test_audit_rows_list_the_units_of_every_part(spark, monkeypatch):
    """The registered query with lists in parts of four units and units in parts of one message, against its SQL."""
    sf = "/root/testdata/sf0.001"
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"create view events as select * from '{sf}/events.parquet'")
    want = {r[0]: r[-1] for r in con.execute(registry.ORACLES["audit_log_with_digests"]).fetchall()}
    monkeypatch.setattr(unit_store, "session_digests", functools.partial(unit_store.session_digests, part_units=4))
    monkeypatch.setattr(unit_store, "unit_documents", functools.partial(unit_store.unit_documents, part_rows=1))
    got = {r.seq: r.purged_hashes for r in audits.audit_log_with_digests(spark, sf).collect()}
    assert got == want and max(len(h.split(",")) for h in want.values() if h) > 8


def test_reductions_round_ties_as_the_sql(spark, tmp_path):
    """Users of the given events with a reduction of 0.60625 or 0.63125."""
    duckdb = pytest.importorskip("duckdb")
    spark.read.parquet("/root/testdata/sf0.1/events.parquet").filter("user_id IN (125, 150, 1446, 7)").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    result = con.execute(registry.ORACLES["audit_log_with_digests"])
    names = [d[0] for d in result.description]
    want = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r[n] for n in names)) for r in audits.audit_log_with_digests(spark, str(tmp_path)).collect()) == want
