from __future__ import annotations

import json
import random

import pandas as pd
from pyspark.sql import functions as F

import brute
from palimpsest.operators import ledger as L
from palimpsest.streaming import audit_stream, ledger_stream, session_state, signal_stream
from palimpsest.streaming.sinks import append_to_table, latest_to_table


def write_log(folder, name, rows):
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_live_totals_match_fixture(spark, tmp_path):
    write_log(tmp_path, "1.json", [dict(model="a", tokens_before=5000, tokens_after=200, reduction=0.96, blocks_purged=2), "garbage", ""])
    write_log(tmp_path, "2.json", [dict(model="b", tokens_before=3000, tokens_after=150), dict(tokens_before=1000, tokens_after=500)])
    stream = audit_stream.follow_audit(spark, str(tmp_path), files_per_batch=1)
    total = latest_to_table(audit_stream.live_totals(stream), "t").collect()
    assert len(total) == 1 and (total[0].requests, total[0].tokens_before, total[0].peak_reduction) == (3, 9000, 0.96)
    models = {r.model: r.requests for r in latest_to_table(audit_stream.live_model_totals(stream), "m").collect()}
    assert models == {"a": 1, "b": 1, "?": 1}


def test_rate_skips_replayed_history(spark, tmp_path):
    rows = [dict(ts=f"2026-01-01T00:00:{s:02d}", tokens_before=1) for s in (0, 10, 20)] + [dict(ts="2026-01-01T00:30:00", tokens_before=1)]
    write_log(tmp_path, "1.json", rows)
    stream = audit_stream.follow_audit(spark, str(tmp_path))
    rate = append_to_table(audit_stream.request_rate(stream, live_after="2026-01-01T00:00:00"), "rate")
    assert rate.agg(F.max("requests")).first()[0] == 2


def test_session_pruner(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for s in range(3):
        rows.append((s, 0, "purpose", "Goal", None, None))
        for i in range(1, 60):
            if rng.random() < 0.4:
                rows.append((s, i, "cycle", None, None, None))
            else:
                rows.append((s, i, "insert", f"text {rng.randint(0, 9)}", rng.choice([1, 2, 4, 16, 32]), rng.choice([None, None, 0.5])))
    frame = pd.DataFrame(rows, columns=["session_id", "seq", "kind", "content", "signal", "oxygen"])
    schema = "session_id BIGINT, seq BIGINT, kind STRING, content STRING, signal INT, oxygen DOUBLE"
    cols = frame.columns.tolist()
    out = None
    for part, keep in ((0, lambda q: q < 25), (1, lambda q: q >= 25)):
        batch = [r for r in rows if keep(r[1])]
        spark.createDataFrame(batch, schema).select(*cols).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        pruned = session_state.prune_live_sessions(stream, capacity=3)
        out = append_to_table(pruned, "p", path=str(tmp_path / "out"), checkpoint=str(tmp_path / "cp"))
    got = {(r.session_id, r.cycle): r for r in out.collect()}
    for s in range(3):
        live, notes, cycle, freed = [], [], 0, 0
        for _, _, kind, content, signal, oxygen in [r for r in rows if r[0] == s]:
            if kind == "insert":
                live.append([content, brute.weight(signal) if oxygen is None else oxygen, signal])
            elif kind == "cycle":
                cycle += 1
                left, purged = [], 0
                for b in live:
                    b[1] = b[1] + 0.5 if b[2] & 9 else b[1] * 2.0**-0.5
                    if b[2] & 9 or b[1] >= 0.35:
                        left.append(b)
                    else:
                        purged, freed = purged + 1, freed + brute.tokens(b[0])
                        if b[2] & 6:
                            notes.append(b[0])
                live, held = left, brute.fifo(notes, 3)
                r = got[(s, cycle)]
                assert (r.purged, r.active_blocks, r.reclaimed_tokens, list(r.state)) == (purged, len(live), freed, held)
                state = "STATE:\n" + "".join(f"- {n}\n" for n in held) if held else ""
                assert r.context == "Goal\n" + state + "\n".join(b[0] for b in live)


class CountedState:
    """A map or value state that counts its calls."""

    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name in ("updateValue", "update"):
                self.held[args[0] if len(args) == 2 else None] = args[-1]
            elif name == "iterator":
                return iter(list(self.held.items()))
            elif name == "removeKey":
                self.held.pop(args[0], None)
            else:
                found = self.held.get(args[0] if args else None)
                return found if name in ("get", "getValue") else found is not None

        return call


def test_session_state_is_read_and_written_once_a_batch():
    """Calls to the state do not grow with the blocks and cycles of a batch."""
    calls = []
    state = lambda *args, **kw: CountedState(calls)
    wheel = session_state.ExpiryWheel(64, True, None)
    wheel.init(type("Handle", (), dict(getValueState=state, getMapState=state, getListState=state))())
    rows = [(i, "cycle" if i % 10 == 9 else "insert", f"t{i}", 1, None if i % 2 else 2.0, None) for i in range(500)]
    out = []
    for part in (rows[:250], rows[250:]):
        out += list(wheel.handleInputRows(("s",), iter([pd.DataFrame(part, columns=["seq", "kind", "content", "size", "life", "line"])]), None))
    assert len(calls) <= 10
    last = pd.concat(out).iloc[-1]
    assert (last.cycle, last.purged, last.active_blocks) == (50, 5, 205) and last.body.split("\n")[-1] == "t498"


def test_chain_continues_over_batches(spark, tmp_path):
    rows = [(i, "d", f"t{i}", "m", 10 + i, i) for i in range(30)]
    audit = spark.createDataFrame(rows, "seq BIGINT, deployment STRING, ts STRING, model STRING, tokens_before BIGINT, tokens_after BIGINT")
    whole = {r.seq: r.hash for r in L.chain(audit).collect()}
    first = ledger_stream.append_batch(audit.filter("seq < 13"), None)
    second = ledger_stream.append_batch(audit.filter("seq >= 13"), ledger_stream._ends(first, None))
    assert {r.source_seq: r.hash for r in first.unionByName(second).collect()} == whole


def test_late_rows_take_the_next_places(spark, tmp_path):
    """Rows that come out of order are chained as they arrive, and the chain verifies."""
    rng = random.Random(2)
    rows = [(i, f"d{i % 2}", f"t{i}", "m", 10 + i, i) for i in range(40)]
    rng.shuffle(rows)
    folder, out = tmp_path / "log", str(tmp_path / "chain")
    folder.mkdir()
    for k in range(4):
        write_log(folder, f"{k}.json", [dict(zip(("seq", "deployment", "ts", "model", "tokens_before", "tokens_after"), r)) for r in rows[10 * k : 10 * k + 10]])
        ledger_stream.chain_stream(audit_stream.follow_audit(spark, str(folder)), f"{out}/rows", f"{out}/progress")
    chained = ledger_stream.stored_chain(spark, f"{out}/rows")
    assert sorted(r.source_seq for r in chained.collect()) == list(range(40))
    for d in ("d0", "d1"):
        got = [r.source_seq for r in chained.filter(F.col("deployment") == d).orderBy("seq").collect()]
        assert got == [i for k in range(4) for i in sorted(r[0] for r in rows[10 * k : 10 * k + 10] if r[1] == d)]
    assert all(r.ok and r.requests == 20 for r in L.verify(chained.drop("batch")).collect())


def test_recent_requests(spark, tmp_path):
    """Exact counts of the last minute at every second with a request, out of order and to the end of the log."""
    rng = random.Random(3)
    seconds = sorted(rng.sample(range(400), 60)) + [399, 399]
    rows = [dict(ts=f"2026-01-01T00:{s // 60:02d}:{s % 60:02d}", deployment=f"d{s % 2}", tokens_before=1) for s in seconds]
    mixed = sorted(rows, key=lambda r: (r["ts"][:18], rng.random()))
    write_log(tmp_path, "1.json", mixed[:30])
    write_log(tmp_path, "2.json", mixed[30:])
    write_log(tmp_path, "3.json", [dict(ts="2026-01-01T00:30:00")])
    stream = audit_stream.follow_audit(spark, str(tmp_path), files_per_batch=1)
    got = append_to_table(audit_stream.recent_requests(stream), "recent").collect()
    start = 1767225600
    want = {(f"d{s % 2}", start + s): sum(s - 60 <= o <= s and o % 2 == s % 2 for o in seconds) for s in seconds}
    assert {(r.deployment, r.second): r.requests for r in got} == want and len(got) == len(want)


def test_recent_requests_of_a_busy_key(spark, tmp_path):
    """A key with requests in thousands of seconds is dealt by time, with no state that is read again for every second."""
    rng = random.Random(4)
    seconds = sorted(rng.randrange(40000) for _ in range(6000))
    stamp = lambda s: f"2026-01-01T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    write_log(tmp_path, "1.json", [dict(ts=stamp(s), deployment="d", tokens_before=1) for s in seconds] + [dict(ts=stamp(41000))])
    recent = audit_stream.recent_requests(audit_stream.follow_audit(spark, str(tmp_path)))
    assert "InPandas" not in recent._jdf.queryExecution().analyzed().toString()
    got = append_to_table(recent, "recent").collect()
    base, start, want = 1767225600, 0, {}
    for i, s in enumerate(seconds):
        while seconds[start] < s - 60:
            start += 1
        want[base + s] = i - start + 1
    assert {r.second: r.requests for r in got} == want and len(got) == len(want)


def test_alerts_and_ticks(spark, tmp_path):
    spark.createDataFrame([("spam now " * 60,), ("a quiet line",)], "text STRING").write.parquet(str(tmp_path / "texts"))
    texts = spark.readStream.schema("text STRING").parquet(str(tmp_path / "texts"))
    levels = latest_to_table(signal_stream.channel_stream(signal_stream.alert_stream(texts)), "a").collect()
    assert sorted(r.channel for r in levels) == [0, 1, 2, 3] and all(0.85 < r.concentration <= 1 for r in levels)
