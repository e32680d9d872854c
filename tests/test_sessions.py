"""Pruning, units, zones, repair and replay against plain Python, with whole and with blocked sessions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import brute
from palimpsest import config as C
from palimpsest.config import AGENT_CONFIG, PruneConfig
from palimpsest.functions import classes as K
from palimpsest.functions import text as T
from palimpsest.operators import prune, repair, replay, units
from palimpsest.operators.sequence import Layout, dense_positions, fitting_block_rows, largest_group

BLOCKS = [0, 3, 7]
SIGNALS = {"system": 1, "user": 2, "assistant": 4, "tool": 16}


def random_sessions(seed: int, sessions: int = 6, longest: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        for p in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "assistant", "tool", "tool", "system"])
            rows.append((s, p, role, "x" * rng.randint(0, 90), rng.random() < 0.6, rng.random() < 0.5, rng.random() < 0.15))
    return rows


def session_frame(spark, rows):
    df = spark.createDataFrame(
        rows, "session_id BIGINT, pos BIGINT, role STRING, text STRING, has_calls BOOLEAN, has_result BOOLEAN, cached BOOLEAN"
    )
    sizes = df.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return df.join(sizes, "session_id").withColumn("signal", K.class_of_role(F.col("role")))


def as_dicts(rows):
    out: dict[int, list[dict]] = {}
    for s, p, role, text, calls, result, cached in rows:
        out.setdefault(s, []).append(
            dict(session=s, pos=p, role=role, text=text, has_calls=calls, has_use=calls, has_result=result, cached=cached)
        )
    return out


def test_config_rejects_bad_values():
    for bad in (dict(half_life=float("nan")), dict(stable_prefix=-2), dict(quantum=-1), dict(hysteresis=-0.1), dict(block_rows=-1)):
        with pytest.raises(ValueError):
            PruneConfig(**bad)


@pytest.mark.parametrize("threshold,expected", [(0.35, (9, 4, -1, -1)), (0.2, (13, 9, 1, -1))])
def test_cutoff_ages(threshold, expected):
    cfg = PruneConfig(threshold=threshold)
    weights = (C.WEIGHT_TALK, C.WEIGHT_OTHER, C.WEIGHT_TOOL, C.WEIGHT_THINKING)
    assert tuple(cfg.cutoff_age(w) for w in weights) == expected
    assert PruneConfig(threshold=0.0).cutoff_age(0.15) is None


def test_cutoffs_equal_the_direct_test():
    for half_life in (0.05, 1.0, 2.0, 3.0, 6.0, 17.0):
        for threshold in (0.01, 0.1, 0.2, 0.25, 0.35, 0.5, 0.6, 1.0, 2.0):
            cfg = PruneConfig(half_life=half_life, threshold=threshold)
            for w in (0.15, 0.25, 0.6, 1.0):
                cut = cfg.cutoff_age(w)
                for age in range(60):
                    direct = w * 2.0 ** (-age / max(half_life, 0.1)) >= threshold
                    assert (age <= cut) == direct or abs(w * 2.0 ** (-age / max(half_life, 0.1)) - threshold) < 1e-6


def test_class_rules(spark):
    rows = [("system", None, 0, "a", 1), ("fact", None, 0, "a", 8), ("tool", None, 0, "a", 16), ("odd", None, 0, "a", 2), (None, None, 0, "a", 2)]
    df = spark.createDataFrame(rows, "role STRING, mark STRING, calls INT, text STRING, want INT")
    assert all(r.got == r.want for r in df.withColumn("got", K.class_of_role(F.col("role"))).collect())
    marked = [
        ("user", "PIN", 0, "a", 8), ("system", None, 0, "a", 1), ("function", None, 0, "a", 16), ("assistant", None, 1, "  ", 16),
        ("assistant", None, 1, "text", 4), ("assistant", None, 0, "", 4), ("user", "x", 0, "a", 2),
    ]
    df = spark.createDataFrame(marked, "role STRING, mark STRING, calls INT, text STRING, want INT")
    got = df.withColumn("got", K.class_of_marked(F.col("role"), F.col("mark"), F.col("calls"), F.col("text"))).collect()
    assert all(r.got == r.want for r in got)


def test_durable_texts(spark):
    yes = [
        "The handler must return 429.", "Never log the raw key", "remember the port is 8080", "we agreed on UTC", "Decision: use Avro",
        "Don't forget the index", "O limite deve ser 350", "nunca apague o cache", "não pode falhar", "É obrigatório validar", "isto é OBRIGATÓRIO",
    ]
    no = ["ok", "thanks, looks good", "mustard on bread", "what is the weather", "", "   ", "must " * 200]
    df = spark.createDataFrame([(t, True) for t in yes] + [(t, False) for t in no], "text STRING, want BOOLEAN")
    assert [r for r in df.withColumn("got", K.looks_durable(F.col("text"))).collect() if r.got != r.want] == []


def test_token_sizes_count_bytes(spark):
    df = spark.createDataFrame([("",), ("abcd",), ("ééé",), (None,)], "text STRING")
    got = [(r.t, r.q) for r in df.select(T.token_size(F.col("text")).alias("t"), T.char_quarter(F.col("text")).alias("q")).collect()]
    assert got == [(1, 0), (2, 1), (2, 0), (1, 0)]


def test_digest_cuts_at_whole_characters(spark):
    def shortened(text):
        """The shortest start of at least 120 bytes, marked if something is left."""
        flat = " ".join(text.split())
        n = next((n for n in range(len(flat) + 1) if len(flat[:n].encode()) >= 120), len(flat))
        return flat if n == len(flat) else flat[:n] + "…"

    texts = ["a" * 120, "a" * 121, "a" * 119 + "é", "a" * 119 + "éb", "a" * 118 + "€uro", "b" * 117 + "😀😀", "  x \n y\t z ", "é" * 200, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    got = [r[0] for r in df.select(T.one_line_digest(F.col("text"))).collect()]
    assert got == [shortened(t) for t in texts]


def test_prune_audit(spark):
    rows = random_sessions(1)
    cfg = PruneConfig(half_life=3.0, threshold=0.3, stable_prefix=2)
    decided = prune.decide(session_frame(spark, rows), cfg)
    got = {r.session_id: r for r in prune.session_audit(decided).collect()}
    for s, msgs in as_dicts(rows).items():
        keep = brute.keep_flags([SIGNALS[m["role"]] for m in msgs], 3.0, 0.3, 2)
        sizes = [brute.tokens(m["text"]) for m in msgs]
        assert got[s].blocks_in == len(msgs) and got[s].blocks_kept == sum(keep)
        assert got[s].tokens_before == sum(sizes)
        assert got[s].tokens_after == sum(t for t, k in zip(sizes, keep) if k)
        assert got[s].stable_prefix_tokens == sum(sizes[:2])


def test_survivors_are_a_subset(spark):
    df = session_frame(spark, random_sessions(2))
    kept = prune.survivors(prune.decide(df, PruneConfig()))
    assert prune.deletion_only_violations(df, kept).count() == 0
    changed = kept.withColumn("text", F.concat("text", F.lit("!")))
    assert prune.deletion_only_violations(df, changed).count() == kept.count()


def test_render_in_parts_equals_whole(spark):
    df = session_frame(spark, random_sessions(3, 3, 30)).filter("length(text) > 0")
    whole = {r.session_id: r.context for r in prune.render(df).collect()}
    parts: dict[int, list] = {}
    for r in prune.render(df, part_rows=4).collect():
        parts.setdefault(r.session_id, []).append((r.part, r.context))
    assert {s: "\n".join(c for _, c in sorted(p)) for s, p in parts.items()} == whole
    requests = df.select("session_id").distinct().withColumn("request", F.lit("go"))
    pieces: dict[int, list] = {}
    for r in prune.prompts(prune.render(df, part_rows=4), requests).collect():
        pieces.setdefault(r.session_id, []).append((r.part, r.prompt))
    for s, p in pieces.items():
        assert "".join(c for _, c in sorted(p)) == f"Context:\n{whole[s]}\n\nRequest:\ngo"


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_units(spark, block_rows):
    rows = random_sessions(4)
    cfg = PruneConfig(block_rows=block_rows)
    df = units.plain_messages(session_frame(spark, rows), has_calls=F.col("has_calls"), has_use=F.col("has_calls"), has_result=F.col("has_result"))
    for operator, brute_units in ((units.call_run_units, brute.call_units), (units.paired_units, brute.pair_units)):
        got = {(r.session_id, r.pos): r.unit_id for r in operator(df, cfg).collect()}
        want = {(m["session"], m["pos"]): i for msgs in as_dicts(rows).values() for i, u in enumerate(brute_units(msgs)) for m in u}
        assert got == want


def gateway(msgs, cfg, blocks):
    """(kept positions, tokens before, tokens after) of one session."""
    users = [m["pos"] for m in msgs if m["role"] == "user"]
    if not users:
        return [m["pos"] for m in msgs], 0, 0
    split = users[-1]
    if blocks and split > 0 and msgs[split]["has_result"] and msgs[split - 1]["role"] == "assistant" and msgs[split - 1]["has_use"]:
        split -= 1
    grouped = (brute.pair_units if blocks else brute.call_units)(msgs[:split])
    stable = cfg.stable_prefix
    if stable < 0:
        stable = next((i + 1 for i, u in enumerate(grouped) if any(m["cached"] for m in u)), 0)
    edge = len(grouped) // cfg.quantum * cfg.quantum if cfg.quantum else len(grouped)
    mobile, frozen = grouped[:edge], grouped[edge:]
    if blocks:
        stable = max(stable, 1)
    signals = []
    for u in mobile:
        tool = any(m["role"] == "tool" or m["has_calls"] or m["has_use"] or m["has_result"] for m in u)
        first = u[0]
        signals.append(8 if first["cached"] else 1 if first["role"] == "system" else 16 if tool else 4 if first["role"] == "assistant" else 2)
    keep = brute.keep_flags(signals, cfg.half_life, cfg.threshold, min(stable, len(mobile)))
    sizes = [brute.tokens("\n".join(m["text"] for m in u)) for u in mobile]
    cold = sum(len("\n".join(m["text"] for m in u)) // 4 for u in frozen)
    before, after = sum(sizes) + cold, sum(t for t, k in zip(sizes, keep) if k) + cold
    red = 1 - after / before if before else 0.0
    if cfg.hysteresis > 0 and red < cfg.hysteresis:
        return [m["pos"] for m in msgs], before, before
    kept = [m["pos"] for u, k in zip(mobile, keep) if k for m in u] + [m["pos"] for u in frozen for m in u] + [m["pos"] for m in msgs[split:]]
    return kept, before, after


@pytest.mark.parametrize("block_rows", BLOCKS)
@pytest.mark.parametrize("surface", ["chat", "blocks"])
@pytest.mark.parametrize(
    "cfg",
    [PruneConfig(), AGENT_CONFIG.with_(stable_prefix=-1), PruneConfig(stable_prefix=2, quantum=4), PruneConfig(quantum=3, hysteresis=0.4)],
)
def test_gateway(spark, block_rows, surface, cfg):
    rows = random_sessions(5, 8)
    cfg = cfg.with_(block_rows=block_rows)
    df = units.plain_messages(
        session_frame(spark, rows), has_calls=F.col("has_calls") & (F.lit(surface) == "chat"),
        has_use=F.col("has_calls") & (F.lit(surface) == "blocks"), has_result=F.col("has_result") & (F.lit(surface) == "blocks"), cached=F.col("cached"),
    )
    grouped, decided = units.gateway_plan(df, cfg, surface)
    audit = {r.session_id: r for r in units.unit_audit(decided).collect()}
    kept: dict[int, list[int]] = {}
    for r in units.reassemble(grouped, decided, df).collect():
        kept.setdefault(r.session_id, []).append(r.pos)
    for s, msgs in as_dicts(rows).items():
        for m in msgs:
            m["has_calls"], m["has_use"] = m["has_calls"] and surface == "chat", m["has_use"] and surface == "blocks"
            m["has_result"] = m["has_result"] and surface == "blocks"
        want, before, after = gateway(msgs, cfg, surface == "blocks")
        assert sorted(kept[s]) == want
        assert (audit[s].tokens_before, audit[s].tokens_after) == (before, after)


def test_structured_messages(spark):
    part = dict(type=None, text=None, cache_control=None, id=None, tool_use_id=None)
    rows = [
        dict(session_id="a", pos=0, role="user", content=None, mark=None, parts=[dict(part, type="text", text="FACT: x", cache_control=True), dict(part, type="image")], tool_calls=None),
        dict(session_id="a", pos=1, role="assistant", content="hé", mark=None, parts=None, tool_calls=[dict(id="1", function="{}")]),
        dict(session_id="a", pos=2, role="user", content=None, mark=None, parts=[dict(part, type="tool_result", tool_use_id="u")], tool_calls=[]),
    ]
    got = units.flatten_messages(spark.createDataFrame(rows, units.MESSAGE_SCHEMA)).orderBy("pos").collect()
    assert (got[0].size_bytes, got[0].size_pieces, got[0].tagged, got[0].cached) == (7 + 6400, 2, True, True)
    assert (got[1].size_bytes, got[1].size_chars, got[1].size_pieces, got[1].has_calls) == (5, 4, 2, True)
    assert got[2].has_result and got[2].result_ids == ["u"] and not got[2].has_use


def test_marker_counts_in_unit_size(spark):
    df = units.plain_messages(session_frame(spark, [(0, 0, "user", "abc", False, False, False), (0, 1, "user", "q", False, False, False)]))
    grouped = units.call_run_units(units.split_at_query(df))
    plain = {r.unit_id: r.tokens for r in units.build_units(grouped).collect()}
    marked = {r.unit_id: r.tokens for r in units.build_units(grouped, include_marker=True).collect()}
    assert plain[0] == 1 and marked[0] == (4 + 3) // 4 + 1


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_moved_rows_are_found(spark, block_rows):
    rng = random.Random(9)
    places = {s: rng.sample(range(30), 30) if s else list(range(30)) for s in range(3)}
    df = spark.createDataFrame([(s, p, k) for s, own in places.items() for k, p in enumerate(own)], "session_id BIGINT, pos BIGINT, place BIGINT")
    got = sorted((r.session_id, r.pos) for r in prune.order_violations(df, block_rows=block_rows).collect())
    assert got == sorted((s, p) for s, own in places.items() for q, p in zip(own, own[1:]) if q > p)


def repair_rows(seed, sessions=25):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        for p in range(rng.randint(1, 25)):
            role = rng.choice(["user", "user", "assistant", "assistant", "system"])
            uses = rng.sample(["a", "b"], rng.randint(1, 2)) if role == "assistant" and rng.random() < 0.7 else []
            results = rng.sample(["a", "b"], rng.randint(1, 2)) if rng.random() < (0.15 if role == "assistant" else 0.6) else []
            rows.append(dict(session_id=s, pos=p, role=role, text="t", has_use=bool(uses), has_result=bool(results), use_ids=uses, result_ids=results))
    return rows


def test_long_chains_of_answers(spark):
    """Rows that answer and call at once, one after the other: pointers double instead of a scan of the run."""
    rows = [dict(session_id=0, pos=0, role="user", use_ids=[], result_ids=[]), dict(session_id=0, pos=1, role="assistant", use_ids=["c1"], result_ids=[])]
    for p in range(2, 90):
        gives = ["other"] if p % 7 == 6 else [f"c{p - 2 if p % 7 == 0 else p - 1}"] + (["c1"] if p % 11 == 0 else [])
        rows.append(dict(session_id=0, pos=p, role="assistant", use_ids=[f"c{p}", "c1"], result_ids=gives))
    rows += [dict(session_id=0, pos=90, role="user", use_ids=[], result_ids=["c1"]), dict(session_id=0, pos=91, role="user", use_ids=[], result_ids=[])]
    rows = [r | dict(text="t", has_use=bool(r["use_ids"]), has_result=bool(r["result_ids"])) for r in rows]
    schema = "session_id BIGINT, pos BIGINT, role STRING, text STRING, has_use BOOLEAN, has_result BOOLEAN, use_ids ARRAY<STRING>, result_ids ARRAY<STRING>"
    got = sorted(r.pos for r in repair.repair(spark.createDataFrame(rows, schema), 0).collect())
    assert got == brute.repaired(rows) and len(got) > 20


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_repair_fuzz(spark, block_rows):
    rows = repair_rows(6)
    schema = "session_id BIGINT, pos BIGINT, role STRING, text STRING, has_use BOOLEAN, has_result BOOLEAN, use_ids ARRAY<STRING>, result_ids ARRAY<STRING>"
    df = spark.createDataFrame(rows, schema)
    got: dict[int, list[int]] = {s: [] for s in range(25)}
    for r in repair.repair(df, block_rows).collect():
        got[r.session_id].append(r.pos)
    for s in range(25):
        assert sorted(got[s]) == brute.repaired([r for r in rows if r["session_id"] == s])


@pytest.mark.parametrize("block_rows", BLOCKS)
@pytest.mark.parametrize("quantum,stable", [(0, 0), (0, 2), (4, 0)])
def test_replay(spark, block_rows, quantum, stable):
    rows = random_sessions(7, 5)
    cfg = PruneConfig(half_life=2.0, threshold=0.2, quantum=quantum, stable_prefix=stable, block_rows=block_rows)
    got = {(r.session_id, r.request_pos): r for r in replay.replay_requests(session_frame(spark, rows), cfg).collect()}
    miss = {r.session_id: r.invalidations for r in replay.prefix_stability(session_frame(spark, rows), cfg).collect()}
    seen = 0
    for s, msgs in as_dicts(rows).items():
        bodies, number = [], 0
        for q, m in enumerate(msgs):
            if m["role"] != "user":
                continue
            number += 1
            seen += 1
            edge = q // quantum * quantum if quantum else q
            keep = brute.keep_flags([SIGNALS[x["role"]] for x in msgs[:edge]], 2.0, 0.2, min(stable, edge))
            sizes = [brute.tokens(x["text"]) for x in msgs[:edge]]
            cold = sum(len(x["text"]) // 4 for x in msgs[edge:q])
            r = got[(s, q)]
            assert (r.request_no, r.tokens_before, r.blocks_purged, r.frozen_units) == (number, sum(sizes) + cold, keep.count(False), q - edge)
            assert r.tokens_after == sum(t for t, k in zip(sizes, keep) if k) + cold
            bodies.append([i for i in range(edge) if keep[i]] + list(range(edge, q)))
        if bodies:
            assert miss[s] == sum(b[: len(a)] != a for a, b in zip(bodies, bodies[1:]))
    assert seen == len(got)


@pytest.mark.parametrize("block_rows", BLOCKS)
def test_step_replay(spark, block_rows):
    rows = random_sessions(8, 4)
    cfg = PruneConfig(half_life=2.0, threshold=0.2, block_rows=block_rows)
    got = {(r.session_id, r.step): r for r in replay.replay_steps(session_frame(spark, rows), cfg, base=3, chunk=5, steps=6).collect()}
    for s, msgs in as_dicts(rows).items():
        for step in range(1, 7):
            k = min(3 + (step - 1) * 5, len(msgs))
            keep = brute.keep_flags([SIGNALS[m["role"]] for m in msgs[:k]], 2.0, 0.2)
            r = got[(s, step)]
            assert r.history_turns == k
            assert r.tokens_after == sum(brute.tokens(m["text"]) for m, f in zip(msgs[:k], keep) if f)


def test_dense_positions_by_cells(spark):
    rng = random.Random(9)
    rows = [(rng.randint(0, 2), c, t) for c in range(40) for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "s INT, c BIGINT, t BIGINT")
    fine = {"c": F.col("c"), "t": F.floor(F.col("t") / 2)}
    cells = dense_positions(df, ["s"], ["c", "t"], fine, F.floor(F.col("c") / 5))
    whole = dense_positions(df, ["s"], ["c", "t"], fine, F.floor(F.col("c") / 5), whole=True)
    columns = ["s", "c", "t", "pos", "n"]
    assert sorted(cells.select(columns).collect()) == sorted(whole.select(columns).collect())
    assert largest_group(df, "s") == max(sum(r[0] == s for r in rows) for s in range(3))
    assert fitting_block_rows(df, "s", block_rows=10) == 10 and fitting_block_rows(df, "s") == 0


def test_layout_whole_session_values(spark):
    df = spark.createDataFrame([(0, p, p * p) for p in range(20)], "k INT, pos BIGINT, v BIGINT")
    for block_rows in BLOCKS:
        layout = Layout(["k"], "pos", block_rows)
        rows = layout.carry(layout.split(df), totals={"t": F.col("v")}, first={"lo": F.col("v")}, final={"hi": F.col("v")}, sums={"b": F.col("v")})
        rows = rows.withColumn("run", layout.running_sum(F.col("v"), F.col("b")))
        assert {(r.t, r.lo, r.hi) for r in rows.collect()} == {(sum(p * p for p in range(20)), 0, 361)}
        assert {r.pos: r.run for r in rows.collect()} == {p: sum(i * i for i in range(p + 1)) for p in range(20)}
