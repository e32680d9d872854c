from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import brute
from palimpsest.config import PruneConfig
from palimpsest.functions import secrets as X
from palimpsest.functions import text as T

from palimpsest.operators import decay, scans


def test_flood_fixture(spark):
    texts = ["ACK PSH SYN forged repeat " * 200, "ACK PSH repeat forged log " * 500, "too short", "the quick brown fox jumps over a lazy dog while it rains in the north sea"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    got = {r.id: (r.score, r.alert) for r in scans.flood_scores(df, "id").collect()}
    assert got[0][0] == pytest.approx(988 / 993) and got[1][0] == pytest.approx(0.99799438, abs=1e-8) and got[1][1]
    assert got[2] == (0.0, False) and got[3][0] < 0.5


def test_flood_matches_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["a b\t\n c " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    for width in (1, 3, 8):
        got = {r.id: r.score for r in scans.flood_scores(df, "id", window=width).collect()}
        assert all(got[i] == pytest.approx(brute.repetition(t, width)) for i, t in enumerate(texts))


@pytest.mark.parametrize("block_rows", [0, 2, 5])
def test_session_flood_crosses_messages(spark, block_rows):
    rng = random.Random(2)
    rows = [(s, p, " ".join(rng.choice("ab") for _ in range(rng.choice([0, 0, 1, 1, 2, 9])))) for s in range(5) for p in range(30)]
    df = spark.createDataFrame(rows, "session_id INT, pos BIGINT, text STRING")
    got = {r.session_id: r.score for r in scans.session_flood(df, ["session_id"], block_rows=block_rows).collect()}
    for s in range(5):
        assert got[s] == pytest.approx(brute.repetition("\n".join(t for k, _, t in rows if k == s)))


def test_session_flood_deals_out_one_session(spark, monkeypatch):
    # a session that fits a block went to one task with all its shingles.
    monkeypatch.setattr(scans, "FLOOD_ROWS", 4, raising=False)
    monkeypatch.setattr(scans, "FLOOD_BYTES", 64, raising=False)
    texts = [None, "\u00a0 ", *[f"a\u00a0b c{p % 3}\n" * (p % 4) for p in range(60)], " last  word"]
    df = spark.createDataFrame([(7, p, t) for p, t in enumerate(texts)], "session_id INT, pos BIGINT, text STRING")
    flood = scans.session_flood(df, ["session_id"])
    tasks = -(-sum(len(t.encode()) for t in texts if t and t.strip()) // 64)
    plan = flood._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"hashpartitioning\(session_id#\d+, _block#\d+L, {tasks}\)", plan)
    row = flood.collect()[0]
    words = "\n".join(t or "" for t in texts).split()
    assert row.tokens == len(words) and row.score == pytest.approx(brute.repetition(" ".join(words)))


@pytest.mark.parametrize("n", [0, 1, 3])
def test_first_words(spark, n):
    texts = ["", " ", "a", " a b", "a  b c d", "\ta\nb\u00a0c d e ", "a b c "]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    assert [r[0] for r in df.select(T.first_words(F.col("text"), n)).collect()] == [t.split()[:n] for t in texts]


def effort_of(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id INT, text STRING")
    return [r for r in scans.effort(df).orderBy("id").collect()]


def test_effort_tiers(spark):
    hard = ("Design and implement a migration plan; analyze why the integration must never fail, always validate, ensure without error, "
            "refactor class Foo { return bar(1, 2, 3); } and evaluate 12345 67890 constraint requirement except invariant ") 
    long = hard + " ".join(f"word{i}" for i in range(400))
    got = effort_of(spark, ["sim, continue", "ok", "analyze the big plan", long, "", "no"])
    assert [r.tier for r in got] == ["off", "off", "low", "high", "off", "off"]
    assert got[0].score <= 0.0500001 and got[3].budget_tokens == 16384 and got[2].budget_tokens == 1024


def test_effort_signals(spark):
    row = effort_of(spark, ["Why? (plan) must! não; OK fn x = {1}; obrigatório designs unplanned prove-it"])[0]
    s = row.signals
    # why, plan, designs are hard; "unplanned" and "prove-it" are neither whole words nor stems
    assert (s.words, s.hard_hits, s.constraint_hits, s.trivial_hits) == (13, 3, 2, 2)
    assert s.code_hits == 1 + 7 // 6 and s.digits == 1


def test_effort_policy(spark):
    hard = "implement and refactor and design the whole audit, must never fail, always ensure " + " ".join(f"w{i}" for i in range(300))
    rows = [
        ("chat", "sim, continue", False, None, None, None, None, "disabled", None),
        ("chat", hard, True, None, None, None, None, "client_set", None),
        ("blocks", "ok, prossiga", False, "enabled", 16000, None, None, "downgraded 16000->1024", 1024),
        ("blocks", hard, False, "enabled", 2048, None, None, "client_set", 2048),
        ("blocks", hard, False, None, None, None, 32000, "added", None),
        ("blocks", hard, False, None, None, 0.0, 32000, "none", None),
        ("blocks", hard, False, None, None, 1.0, 1100, "none", None),
        ("blocks", "", False, None, None, None, 32000, None, None),
    ]
    schema = "surface STRING, text STRING, has_reasoning BOOLEAN, thinking_type STRING, thinking_budget INT, temperature DOUBLE, max_tokens INT, want STRING, budget BIGINT"
    for r in scans.effort_policy(spark.createDataFrame(rows, schema)).collect():
        if r.want == "added":
            assert r.action == f"added {r.new_budget}" and r.new_budget in (4096, 16384)
        else:
            assert (r.action, r.new_budget) == (r.want, r.budget)
        assert (r.tier is None) == (r.text == "")
    chat = spark.createDataFrame([("chat", hard, False, None, None, None, None, "", None)], schema)
    row = scans.effort_policy(chat).collect()[0]
    assert row.action == f"effort={row.tier}" and row.tier in ("medium", "high")


def test_consolidation_fixture(spark):
    rows = [(10000, 4000, 8, -3700.0, 17.25), (10000, 9000, 8, 6050.0, 1.2777777), (10000, 0, 8, -11500.0, float("inf")), (100, 500, 0, 10.0, 0.0)]
    df = spark.createDataFrame(rows, "prefix_tokens BIGINT, purgeable_tokens BIGINT, calls_ahead INT, gain_want DOUBLE, even_want DOUBLE")
    for r in scans.consolidation(df).collect():
        assert r.gain == pytest.approx(r.gain_want) and r.break_even_calls == pytest.approx(r.even_want)
        assert r.consolidate == (r.gain_want > 0)


def test_secret_patterns(spark):
    # Secret-shaped strings are put together here, so that none is stored.
    body = "A1b2C3d4E5" * 4
    yes = {
        "aws_access_key": "AK" + "IA" + "ABCDEFGH12345678", "aws_secret": "AWS_" + "SECRET = " + body, "openai_key": "s" + "k-" + body,
        "github_token": "gh" + "p_" + body, "slack_token": "xo" + "xb-" + body, "google_api": "AI" + "za" + body, "bearer": "Bearer  " + body,
        "private_key": "-----BEGIN RSA " + "PRIVATE KEY-----",
    }
    near = ["AK" + "IA" + "short", "s" + "k-short", "gh" + "x_" + body, "xo" + "xz-" + body, "AI" + "za short", "bearer abc", "BEGIN PRIVATE KEY"]
    df = spark.createDataFrame([(k, v) for k, v in yes.items()] + [(None, v) for v in near], "want STRING, text STRING")
    assert all(r.got == r.want for r in df.withColumn("got", X.secret_kind(F.col("text"))).collect())
    vaulted = df.withColumn("got", X.secret_kind(F.col("text"), ["BEGIN PRIVATE"])).filter("text = 'BEGIN PRIVATE KEY'").collect()
    assert vaulted[0].got == "vault"
    masked = df.filter("want IS NOT NULL").select(X.mask_patterns(F.col("text")).alias("m"))
    assert all(X.MASK in r.m for r in masked.collect())


def test_vault_redaction(spark):
    texts = ["key=abc and abcabc", "aab", None, "clean"]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING")
    got = [(r.text, r.hits, r.clean) for r in scans.redacted(df, ["abc", "", "aa"]).collect()]
    m = X.MASK
    assert got == [(f"key={m} and {m}{m}", 3, True), (f"{m}b", 1, True), ("", 0, True), ("clean", 0, True)]
    assert [r.vault_entry for r in scans.vault_exposure(df.withColumn("id", F.lit(1)), "id", ["zz", "aa"]).collect()] == [2]
    # A later secret can match inside the mask of an earlier one: it is applied to the masked text.
    again = scans.redacted(spark.createDataFrame([("x1",)], "text STRING"), ["x1", "RED"]).collect()[0]
    assert (again.text, again.hits) == ("[[REDACTED]ACTED]", 2)


def test_hardened_report(spark):
    rows = [(0, p, 6, "user", 2, "old noise " * 3, "history") for p in range(6)] + [(0, 6, 6, "user", 2, "use abc now", "query"), (0, -1, 6, "system", 1, "abc rules", "system")]
    rows += [(1, 0, 0, "user", 2, "ACK PSH SYN forged repeat " * 50, "query")]
    df = spark.createDataFrame(rows, "session_id INT, pos BIGINT, n BIGINT, role STRING, signal INT, text STRING, zone STRING")
    cfg = PruneConfig(half_life=1.0, threshold=0.4, block_rows=0)
    got = {r.session_id: r for r in scans.hardened_report(df, cfg, ["abc"]).collect()}
    assert (got[0].secrets_redacted, got[0].outbound_clean, got[0].red_alert) == (2, True, False)
    assert got[0].tokens_before == 6 * 8 and got[0].tokens_after == 2 * 8
    assert got[1].red_alert and got[1].tokens_before == 0
    prompts = {r.session_id: r.prompt for r in scans.hardened_prompts(df, cfg, ["abc"]).collect()}
    assert prompts[0].endswith("Request:\nuse [REDACTED] now") and prompts[0].count("old noise") == 6


@pytest.mark.parametrize("block_rows", [0, 2, 3])
def test_secrets_over_line_and_part_borders(spark, block_rows):
    texts = ["a SEC", "RET b", "RET", "SEC", "RET SEC", "x"]
    rows = [(0, p, 6, "user", 1, t, "history") for p, t in enumerate(texts)] + [(0, 6, 6, "user", 1, "SEC", "query"), (0, -1, 6, "system", 1, "SEC\nRET", "system")]
    df = spark.createDataFrame(rows, "session_id INT, pos BIGINT, n BIGINT, role STRING, signal INT, text STRING, zone STRING")
    cfg = PruneConfig(half_life=1.0, threshold=0.4, block_rows=block_rows)
    vault = ["SEC\nRET", "b\nRET"]
    row = scans.hardened_report(df, cfg, vault).collect()[0]
    assert (row.secrets_redacted, row.outbound_clean) == (4, True)
    got = sorted(scans.hardened_prompts(df, cfg, vault).collect(), key=lambda r: r.part)
    m = "[REDACTED]"
    assert "".join(r.prompt for r in got) == f"Context:\na {m} {m}\n{m} SEC\nx\n\nRequest:\nSEC" and got[0].system == m


def masked(text, vault):
    hits = 0
    for s in vault:
        hits += text.count(s)
        text = text.replace(s, X.MASK)
    return text, hits, not any(s in text for s in vault)


VAULTS = [["A\nB\nA"], ["A\n\nB", "AB"], ["\nA", "B\n"], ["AB", "]\nA", "]\nB\n["], ["A", "B\nB", "D]\n"], ["]\nB", "A"], ["aa\na", "Ba"], ["RED", "A", "]\n", "B"]]


@pytest.mark.parametrize("vault, block_rows", [*[(v, 3) for v in VAULTS], (VAULTS[0], 0), (VAULTS[-1], 0), (VAULTS[1], 1)])
def test_outbound_masks_what_the_whole_text_has(spark, vault, block_rows):
    # a secret over three parts was lost; rows that no secret runs over stay apart.
    rng = random.Random(len(vault[0]))
    pieces = ["A", "B", "", "aa", "a", "AB", "x", "B"]
    sessions = {s: [rng.choice(pieces) + rng.choice(pieces) * rng.randint(0, 1) for _ in range(12)] for s in range(20)}
    rows = [(s, p, 12, "fact", 8, t or None, "history") for s, texts in sessions.items() for p, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "session_id INT, pos BIGINT, n BIGINT, role STRING, signal INT, text STRING, zone STRING")
    got: dict[int, list] = {}
    for r in scans.outbound(df, PruneConfig(block_rows=block_rows), vault, ["session_id"]).collect():
        got.setdefault(r.session_id, []).append(r)
    for s, texts in sessions.items():
        found = sorted(got[s], key=lambda r: r.pos)
        whole = "\n".join(r.text for r in found), sum(r.hits for r in found), all(r.clean for r in found)
        assert whole == masked("\n".join(texts), vault)


def test_outbound_keeps_rows_apart(spark):
    rows = [(0, p, 9, "fact", 8, t, "history") for p, t in enumerate(["x", "SEC", "RET", "x", "SEC", "y", "RET", "SECRET", "z"])]
    df = spark.createDataFrame(rows, "session_id INT, pos BIGINT, n BIGINT, role STRING, signal INT, text STRING, zone STRING")
    got = scans.outbound(df, PruneConfig(), ["SEC\nRET", "SECRET"], ["session_id"]).orderBy("pos").collect()
    assert [(r.pos, r.hits) for r in got] == [(0, 0), (1, 1), (3, 0), (4, 0), (5, 0), (6, 0), (7, 1), (8, 0)]


def test_probes_and_gates(spark):
    df = spark.createDataFrame([("a", "Alpha BETA"), ("b", "gamma"), ("c", "x")], "scenario STRING, text STRING")
    got = [r.coverage for r in scans.probe_coverage(df, F.col("scenario"), {"a": ["alpha", "beta", "no"], "b": ["GAMMA"]}).collect()]
    assert got == [pytest.approx(2 / 3), 1.0, None]
    gated = scans.keyword_gate(df, F.array(F.lit("Alpha"), F.lit("beta"))).collect()
    assert gated[0].keyword_hits == [True, False] and not gated[0].success
    assert scans.contract_checks(df, {"ok": ["Alpha", "BETA"]}).collect()[0].ok


@pytest.mark.parametrize("block_rows", [0, 3])
@pytest.mark.parametrize("capacity", [1, 2, 5, 64])
def test_state_list_fuzz(spark, block_rows, capacity):
    rng = random.Random(capacity)
    sessions = {0: list("abacda")}
    for s in range(1, 8):
        alphabet = [f"f{i}" for i in range(rng.choice([2, 6, 40]))]
        sessions[s] = [rng.choice(alphabet) for _ in range(rng.randint(1, 60))]
    sessions[9] = [f"u{i}" for i in range(30)] + ["u3", "u29", "u3"]
    rows = [(s, i, f) for s, facts in sessions.items() for i, f in enumerate(facts)]
    df = spark.createDataFrame(rows, "session_id INT, ord BIGINT, fact STRING")
    got = {r.session_id: r.state for r in decay.state_list(df, capacity, block_rows).collect()}
    assert got == {s: brute.fifo(f, capacity) for s, f in sessions.items()}


@pytest.mark.parametrize("block_rows", [0, 4])
def test_cycle_decay_fuzz(spark, block_rows):
    rng = random.Random(4)
    rows = []
    for s in range(5):
        for p in range(40):
            cycle = rng.random() < 0.4
            rows.append((s, p, cycle, rng.choice([1, 2, 4, 8, 16, 32, 0]), "w" * rng.randint(0, 40), rng.choice([None, None, 0.2, 2.5])))
    df = spark.createDataFrame(rows, "session_id INT, pos BIGINT, is_cycle BOOLEAN, signal INT, text STRING, oxygen DOUBLE")
    decayed = decay.decay_cycles(df, block_rows=block_rows)
    got = {(r.session_id, r.pos): r for r in decayed.collect()}
    ratios = {(r.session_id, r.cycle): r for r in decay.reclaimed_ratio(df, decayed, block_rows=block_rows).collect()}
    facts = {}
    for r in decay.absorbed_digests(decayed, block_rows).orderBy("session_id", "ord").collect():
        facts.setdefault(r.session_id, []).append(r.fact)
    factor = 2.0 ** -0.5
    for s in range(5):
        live, cycle, inserted, freed, notes = [], 0, 0, 0, []
        for _, p, is_cycle, signal, text, oxygen in [r for r in rows if r[0] == s]:
            if not is_cycle:
                live.append([p, oxygen if oxygen is not None else brute.weight(signal), signal, text])
                inserted += brute.tokens(text)
                continue
            cycle += 1
            left = []
            for b in live:
                b[1] = b[1] + 0.5 if b[2] & 9 else b[1] * factor
                if b[2] & 9 or b[1] >= 0.35:
                    left.append(b)
                    continue
                freed += brute.tokens(b[3])
                assert got[(s, b[0])].purged_cycle == cycle
                if b[2] & 6:
                    notes.append(b[3])
            live = left
            assert (ratios[(s, cycle)].inserted_tokens, ratios[(s, cycle)].reclaimed_tokens) == (inserted, freed)
        for p, level, _, _ in live:
            assert got[(s, p)].alive and got[(s, p)].level == pytest.approx(level)
        assert facts.get(s, []) == notes


def test_state_rendering(spark):
    df = spark.createDataFrame([(["a", "b"], "ctx"), ([], "ctx"), (None, None)], "state ARRAY<STRING>, context STRING")
    got = [r[0] for r in df.select(decay.render_state("Goal", F.col("state"), F.col("context"))).collect()]
    assert got == ["Goal\nSTATE:\n- a\n- b\nctx", "Goal\nctx", "Goal\n"]

