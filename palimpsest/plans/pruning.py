"""Session pruning: decisions, units, zones, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import AGENT_CONFIG, PruneConfig
from palimpsest.functions import classes as K
from palimpsest.functions import text as T
from palimpsest.operators import prune, replay, units
from palimpsest.operators.sequence import Layout, ages, fitting_block_rows
from palimpsest.plans import sqltext as S
from palimpsest.plans.registry import query
from palimpsest.sources import tables


def long_signals(spark: SparkSession, sf: str) -> tables.Sessions:
    sessions = tables.long_sessions(spark, sf)
    return sessions.with_rows(sessions.rows.withColumn("signal", K.class_of_role(F.col("role"))))


def with_long(spark: SparkSession, sf: str, operator, cfg: PruneConfig, **options) -> DataFrame:
    sessions = long_signals(spark, sf)
    return operator(sessions.rows, sessions.config(cfg), **options)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


DECIDED = f"""
WITH {S.LONG}, sized AS (
  SELECT *, {S.ROLE_SIGNAL} AS signal, {S.TOKENS} AS tok, n - 1 - pos AS age FROM long),
decided AS (SELECT *, {S.alive('signal', 'age')} AS keep FROM sized)"""

AUDIT_COLUMNS = """
  count(*) AS blocks_in, count(*) FILTER (keep) AS blocks_kept, count(*) FILTER (NOT keep) AS blocks_purged,
  sum(tok)::BIGINT AS tokens_before, coalesce(sum(tok) FILTER (keep), 0)::BIGINT AS tokens_after"""


@query(
    "session_prune_audit",
    f"""{DECIDED}
SELECT session_id, {AUDIT_COLUMNS}, 0::BIGINT AS stable_prefix_tokens,
       round(1.0 - coalesce(sum(tok) FILTER (keep), 0) / sum(tok), 6) AS reduction
FROM decided GROUP BY session_id""",
)
def session_prune_audit(spark: SparkSession, sf: str) -> DataFrame:
    decided = prune.decide(long_signals(spark, sf).rows, PruneConfig())
    return rounded(prune.session_audit(decided), "reduction")


@query(
    "prune_audit_conversations",
    f"""WITH c AS (
  SELECT conv_id AS session_id, turn AS pos, role, text, {S.TOKENS} AS tok, {S.ROLE_SIGNAL} AS signal,
         count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
decided AS (SELECT *, pos < 1 AS stable, pos < 1 OR {S.alive('signal', 'n - 1 - pos', 2.0)} AS keep FROM c)
SELECT session_id, {AUDIT_COLUMNS}, sum(tok) FILTER (stable)::BIGINT AS stable_prefix_tokens,
       round(1.0 - coalesce(sum(tok) FILTER (keep), 0) / sum(tok), 6) AS reduction
FROM decided GROUP BY session_id""",
)
def prune_audit_conversations(spark: SparkSession, sf: str) -> DataFrame:
    sessions = tables.conversations(spark, sf)
    cfg = PruneConfig(half_life=2.0, stable_prefix=1)
    rows = ages(sessions.rows, Layout(["session_id"], "pos", sessions.block_rows)).withColumn(
        "signal", K.class_of_role(F.col("role"))
    )
    return rounded(prune.session_audit(prune.decide(rows, cfg)), "reduction")


@query(
    "survivor_split",
    f"""{DECIDED}
SELECT session_id, pos, role, tok AS tokens, CASE WHEN keep THEN 'kept' ELSE 'purged' END AS fate FROM decided""",
)
def survivor_split(spark: SparkSession, sf: str) -> DataFrame:
    decided = prune.decide(long_signals(spark, sf).rows, PruneConfig())
    shape = ["session_id", "pos", "role", "tokens"]
    kept = prune.survivors(decided).select(*shape, F.lit("kept").alias("fate"))
    gone = prune.purged(decided).select(*shape, F.lit("purged").alias("fate"))
    return kept.unionByName(gone)


@query(
    "token_sizes",
    "SELECT doc_id, (strlen(text) // 4 + 1)::BIGINT AS tokens, (length(text) // 4)::BIGINT AS frozen_tokens FROM documents",
)
def token_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "documents").select(
        "doc_id",
        T.token_size(F.col("text")).alias("tokens"),
        T.char_quarter(F.col("text")).alias("frozen_tokens"),
    )


@query(
    "role_classes",
    f"""WITH {S.LONG}, s AS (SELECT role, {S.ROLE_SIGNAL} AS signal FROM long)
SELECT role, signal, {S.weight('signal')} AS weight, count(*) AS rows_in FROM s GROUP BY ALL""",
)
def role_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = long_signals(spark, sf).rows.withColumn("weight", K.weight_of(F.col("signal")))
    return rows.groupBy("role", "signal", "weight").agg(F.count(F.lit(1)).alias("rows_in"))


@query(
    "marked_classes",
    """WITH m AS (
  SELECT conv_id, turn, CASE WHEN turn = 1 THEN 'function' ELSE role END AS role,
         CASE WHEN conv_id % 7 = 0 AND turn = 0 THEN 'Pin' WHEN conv_id % 5 = 0 THEN 'note' END AS mark,
         CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS calls,
         CASE WHEN turn % 2 = 1 AND conv_id % 3 = 0 THEN '  ' ELSE text END AS text
  FROM conversations)
SELECT conv_id, turn,
  CASE WHEN lower(mark) IN ('fact', 'durable', 'pin') THEN 8 WHEN role = 'system' THEN 1
       WHEN role IN ('tool', 'function') THEN 16
       WHEN role = 'assistant' AND calls > 0 AND trim(text) = '' THEN 16
       WHEN role = 'assistant' THEN 4 ELSE 2 END AS signal FROM m""",
)
def marked_classes(spark: SparkSession, sf: str) -> DataFrame:
    turn, conv = F.col("turn"), F.col("conv_id")
    rows = tables.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.when(turn == 1, "function").otherwise(F.col("role")).alias("role"),
        F.when((conv % 7 == 0) & (turn == 0), "Pin").when(conv % 5 == 0, "note").alias("mark"),
        F.when(turn % 3 == 0, 1).otherwise(0).alias("calls"),
        F.when((turn % 2 == 1) & (conv % 3 == 0), "  ").otherwise(F.col("text")).alias("text"),
    )
    signal = K.class_of_marked(F.col("role"), F.col("mark"), F.col("calls"), F.col("text"))
    return rows.select("conv_id", "turn", signal.alias("signal"))


TAGGED_SQL = """CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN ' FACT: ' || text
       WHEN (conv_id + turn) % 7 = 0 THEN 'Never ' || text ELSE text END"""


def tagged_text():
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    return (
        F.when((conv % 5 == 0) & (turn == 0), F.concat(F.lit(" FACT: "), text))
        .when((conv + turn) % 7 == 0, F.concat(F.lit("Never "), text))
        .otherwise(text)
    )


DURABLE_SQL = (
    r"(length(trim(text)) BETWEEN 1 AND 600 AND regexp_matches(text, "
    r"'(?i)\b(must|never|always|shall|required|remember|reminder|important)\b|\bdon''?t forget\b|\bnote this\b"
    r"|\b(we|as) agreed\b|\bdecision:|\b(deve[mr]?|nunca|sempre|lembre(te)?|anote|importante|decidimos|combinamos"
    r"|ficou definido)\b'))"
)


@query(
    "durable_texts",
    f"""WITH t AS (SELECT conv_id, turn, role, {TAGGED_SQL} AS text FROM conversations)
SELECT conv_id, turn, {DURABLE_SQL} AS durable FROM t""",
)
def durable_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "conversations").withColumn("text", tagged_text())
    return rows.select("conv_id", "turn", K.looks_durable(F.col("text")).alias("durable"))


@query(
    "render_contexts",
    f"""{DECIDED}
SELECT session_id, 0::BIGINT AS part, string_agg(text, chr(10) ORDER BY pos) AS context
FROM decided WHERE keep GROUP BY session_id""",
)
def render_contexts(spark: SparkSession, sf: str) -> DataFrame:
    return prune.render(prune.survivors(prune.decide(long_signals(spark, sf).rows, PruneConfig())))


@query(
    "assembled_prompts",
    f"""{DECIDED}, h AS (
  SELECT d.*, max(CASE WHEN role = 'user' THEN pos END) OVER (PARTITION BY session_id) AS q FROM decided d),
x AS (SELECT session_id, string_agg(text, chr(10) ORDER BY pos) FILTER (pos < q AND keep) AS ctx,
             max(text) FILTER (pos = q) AS request FROM h GROUP BY session_id)
SELECT session_id, 0::BIGINT AS part, CASE WHEN coalesce(ctx, '') <> ''
  THEN 'Context:' || chr(10) || ctx || chr(10) || chr(10) || 'Request:' || chr(10) || request ELSE request END AS prompt
FROM x""",
)
def assembled_prompts(spark: SparkSession, sf: str) -> DataFrame:
    sessions = long_signals(spark, sf)
    decided = units.split_at_query(prune.decide(sessions.rows, PruneConfig()), sessions.config())
    parts = prune.render(decided.filter(F.col("keep") & (F.col("pos") < F.col("split"))))
    requests = decided.filter(F.col("pos") == F.col("split")).select("session_id", F.col("text").alias("request"))
    return prune.prompts(parts, requests)


def ev_flags(spark: SparkSession, sf: str) -> tables.Sessions:
    """Event sessions with the flags of call-and-tool messages; a third of the signups carry a cache mark."""
    cached = (F.col("event_type") == "signup") & (F.col("event_id") % 3 == 0)
    return tables.event_sessions(
        spark, sf, prepare=lambda rows: units.plain_messages(rows, has_calls=F.col("has_calls"), cached=cached)
    )


# Units of the event sessions: a call takes the tool rows right after it.
EV_UNITS = f"""
WITH {S.EVENTS}, g AS (
  SELECT *, coalesce(last_value(CASE WHEN role <> 'tool' THEN has_calls END IGNORE NULLS)
              OVER (PARTITION BY session_id ORDER BY pos), FALSE) AS open_call FROM ev),
s AS (SELECT *, CASE WHEN role = 'tool' AND open_call THEN 0 ELSE 1 END AS start,
             max(CASE WHEN role = 'user' THEN pos END) OVER (PARTITION BY session_id) AS split,
             event_type = 'signup' AND event_id % 3 = 0 AS cached FROM g),
u AS (SELECT *, sum(start) OVER (PARTITION BY session_id ORDER BY pos) - 1 AS unit_id FROM s),
units AS (
  SELECT session_id, unit_id, min(pos) AS first_pos, count(*) AS messages, max(split) AS split,
         arg_min(role, pos) AS role, arg_min(cached, pos) AS first_cached_row, bool_or(cached) AS cached,
         bool_or(role = 'tool' OR has_calls) AS is_tool,
         sum(strlen(text)) + count(*) - 1 AS unit_bytes, sum(length(text)) + count(*) - 1 AS unit_chars
  FROM u GROUP BY session_id, unit_id),
classed AS (
  SELECT *, CASE WHEN first_cached_row THEN 8 WHEN role = 'system' THEN 1 WHEN is_tool THEN 16
                 WHEN role = 'assistant' THEN 4 ELSE 2 END AS signal,
         unit_bytes // 4 + 1 AS tokens, unit_chars // 4 AS frozen_tokens,
         count(*) FILTER (first_pos < split) OVER (PARTITION BY session_id) AS history_units,
         min(unit_id) FILTER (first_pos < split AND cached) OVER (PARTITION BY session_id) AS first_cached
  FROM units)"""


def zoned_sql(quantum: int, stable: str, half_life: float, threshold: float) -> str:
    boundary = f"(history_units // {quantum}) * {quantum}" if quantum else "history_units"
    return f"""{EV_UNITS},
bounded AS (SELECT *, {boundary} AS boundary FROM classed),
zoned AS (
  SELECT *, CASE WHEN split IS NULL THEN 'pass' WHEN first_pos >= split THEN 'tail'
                 WHEN unit_id >= boundary THEN 'frozen' WHEN unit_id < least({stable}, boundary) THEN 'stable'
                 ELSE 'mobile' END AS zone FROM bounded),
decided AS (
  SELECT *, zone <> 'mobile' OR {S.alive('signal', 'boundary - 1 - unit_id', half_life, threshold)} AS keep FROM zoned)"""


@query("unit_groups", f"{EV_UNITS} SELECT session_id, pos, unit_id::BIGINT AS unit_id FROM u")
def unit_groups(spark: SparkSession, sf: str) -> DataFrame:
    sessions = ev_flags(spark, sf)
    return units.call_run_units(sessions.rows, sessions.config()).select("session_id", "pos", "unit_id")


@query(
    "unit_classes",
    f"""{EV_UNITS} SELECT session_id, unit_id::BIGINT AS unit_id, messages, signal, tokens::BIGINT AS tokens,
  frozen_tokens::BIGINT AS frozen_tokens FROM classed""",
)
def unit_classes(spark: SparkSession, sf: str) -> DataFrame:
    sessions = ev_flags(spark, sf)
    cfg = sessions.config()
    grouped = units.call_run_units(units.split_at_query(sessions.rows, cfg), cfg)
    return units.build_units(grouped, cfg).select(
        "session_id", "unit_id", "messages", "signal", "tokens", "frozen_tokens"
    )


@query(
    "tagged_unit_classes",
    f"""WITH t AS (SELECT conv_id, turn, role, {TAGGED_SQL} AS text FROM conversations)
SELECT conv_id AS session_id, turn AS unit_id,
  CASE WHEN starts_with(ltrim(text), 'FACT:') THEN 8 WHEN role = 'system' THEN 1 WHEN role = 'assistant' THEN 4
       WHEN {DURABLE_SQL} THEN 8 ELSE 2 END AS signal FROM t""",
)
def tagged_unit_classes(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", tagged_text().alias("text")
    )
    cfg = PruneConfig(auto_fact=True, block_rows=fitting_block_rows(rows, "session_id"))
    grouped = units.call_run_units(units.split_at_query(units.plain_messages(rows), cfg), cfg)
    return units.build_units(grouped, cfg).select("session_id", "unit_id", "signal")


UNIT_AUDIT = """
SELECT session_id, count(*) FILTER (zone IN ('stable', 'mobile')) AS units_in,
  count(*) FILTER (NOT keep) AS blocks_purged,
  sum(CASE WHEN zone IN ('stable', 'mobile') THEN tokens WHEN zone = 'frozen' THEN frozen_tokens ELSE 0 END)::BIGINT
    AS tokens_before,
  sum(CASE WHEN zone IN ('stable', 'mobile') THEN CASE WHEN keep THEN tokens ELSE 0 END
           WHEN zone = 'frozen' THEN frozen_tokens ELSE 0 END)::BIGINT AS tokens_after,
  coalesce(sum(tokens) FILTER (zone = 'stable'), 0)::BIGINT AS stable_prefix_tokens,
  count(*) FILTER (zone = 'frozen') AS frozen_units
FROM decided GROUP BY session_id"""


def audit_sql(decided: str, hysteresis: float = 0.0) -> str:
    return f"""{decided}, audit AS ({UNIT_AUDIT}),
pot AS (SELECT *, CASE WHEN tokens_before > 0 THEN 1.0 - tokens_after / tokens_before ELSE 0 END AS potential FROM audit),
h AS (SELECT *, {hysteresis} > 0 AND potential < {hysteresis} AS held FROM pot)
SELECT session_id, units_in, CASE WHEN held THEN 0 ELSE blocks_purged END AS blocks_purged, tokens_before,
  CASE WHEN held THEN tokens_before ELSE tokens_after END AS tokens_after,
  round(CASE WHEN held THEN 0 ELSE potential END, 6) AS reduction, stable_prefix_tokens, frozen_units, held,
  CASE WHEN held THEN round(potential, 4) END AS potential_reduction
FROM h"""


def ev_audit(spark: SparkSession, sf: str, cfg: PruneConfig) -> DataFrame:
    sessions = ev_flags(spark, sf)
    _, decided = units.gateway_plan(sessions.rows, sessions.config(cfg))
    return rounded(units.unit_audit(decided), "reduction")


@query("query_split_audit", audit_sql(zoned_sql(0, "0", 6.0, 0.35)))
def query_split_audit(spark: SparkSession, sf: str) -> DataFrame:
    return ev_audit(spark, sf, PruneConfig())


@query("auto_prefix_audit", audit_sql(zoned_sql(0, "coalesce(first_cached + 1, 0)", 6.0, 0.2)))
def auto_prefix_audit(spark: SparkSession, sf: str) -> DataFrame:
    return ev_audit(spark, sf, AGENT_CONFIG.with_(stable_prefix=-1))


@query("quantum_audit", audit_sql(zoned_sql(8, "3", 6.0, 0.2)))
def quantum_audit(spark: SparkSession, sf: str) -> DataFrame:
    return ev_audit(spark, sf, AGENT_CONFIG.with_(stable_prefix=3, quantum=8))


HELD = audit_sql(zoned_sql(8, "3", 6.0, 0.35), 0.55)


@query("hysteresis_audit", HELD)
def hysteresis_audit(spark: SparkSession, sf: str) -> DataFrame:
    return ev_audit(spark, sf, PruneConfig(stable_prefix=3, quantum=8, hysteresis=0.55))


@query(
    "unit_zones",
    f"""{zoned_sql(8, "3", 6.0, 0.35)}
SELECT session_id, unit_id::BIGINT AS unit_id, zone, keep FROM decided""",
)
def unit_zones(spark: SparkSession, sf: str) -> DataFrame:
    sessions = ev_flags(spark, sf)
    _, decided = units.gateway_plan(sessions.rows, sessions.config(PruneConfig(stable_prefix=3, quantum=8)))
    return decided.select("session_id", "unit_id", "zone", "keep")


@query(
    "reassembled_messages",
    f"""{zoned_sql(8, "3", 6.0, 0.35)}
SELECT session_id, pos, u.role, d.zone FROM u JOIN decided d USING (session_id, unit_id) WHERE d.keep""",
)
def reassembled_messages(spark: SparkSession, sf: str) -> DataFrame:
    sessions = ev_flags(spark, sf)
    cfg = sessions.config(PruneConfig(stable_prefix=3, quantum=8))
    grouped, decided = units.gateway_plan(sessions.rows, cfg)
    return units.reassemble(grouped, decided).select("session_id", "pos", "role", "zone")


PAIR_SQL = f"""
WITH {S.EVENTS}, f AS (
  SELECT *, role = 'assistant' AND event_type = 'click' AS has_use, event_type = 'error' OR
         (event_type = 'click' AND event_id % 4 = 0) AS has_result FROM ev),
o AS (SELECT *, has_use AND coalesce(lead(has_result) OVER w, FALSE) AS opens FROM f
      WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
r AS (SELECT *, coalesce(max(CASE WHEN NOT opens THEN pos END) OVER (PARTITION BY session_id ORDER BY pos), -1) AS shut
      FROM o),
p AS (SELECT *, opens AND (pos - shut - 1) % 2 = 0 AS pairs FROM r),
s AS (SELECT *, CASE WHEN coalesce(lag(pairs) OVER (PARTITION BY session_id ORDER BY pos), FALSE) THEN 0 ELSE 1 END
        AS start FROM p)
SELECT session_id, pos, (sum(start) OVER (PARTITION BY session_id ORDER BY pos) - 1)::BIGINT AS unit_id FROM s"""


@query("paired_unit_groups", PAIR_SQL)
def paired_unit_groups(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    answered = (kind == "error") | ((kind == "click") & (F.col("event_id") % 4 == 0))
    sessions = tables.event_sessions(
        spark, sf, prepare=lambda rows: units.plain_messages(rows, has_use=kind == "click", has_result=answered)
    )
    return units.paired_units(sessions.rows, sessions.config()).select("session_id", "pos", "unit_id")


@query("deletion_only_check", f"""{DECIDED}, k AS (SELECT session_id, pos, text, CASE WHEN pos % 17 = 3 THEN pos * 2 - 5 ELSE pos * 2 END AS place,
    CASE WHEN pos % 13 = 5 THEN text || '!' ELSE text END AS out FROM decided WHERE keep),
o AS (SELECT *, lag(pos) OVER (PARTITION BY session_id ORDER BY place) > pos AS behind FROM k)
SELECT session_id, count(*) AS rows_out, count(*) FILTER (out <> text) AS changed, count(*) FILTER (behind) AS misplaced FROM o GROUP BY session_id""")
def deletion_only_check(spark: SparkSession, sf: str) -> DataFrame:
    """Pruned sessions, some rows of which were altered or moved on the way out, checked against what came in."""
    sessions = long_signals(spark, sf)
    kept = prune.survivors(prune.decide(sessions.rows, sessions.config()))
    pos = F.col("pos")
    after = kept.withColumns(
        {"text": F.when(pos % 13 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "place": 2 * pos - F.when(pos % 17 == 3, 5).otherwise(0)}
    )
    changed = prune.deletion_only_violations(sessions.rows, after).groupBy("session_id").agg(F.count(F.lit(1)).alias("changed"))
    moved = prune.order_violations(after, block_rows=sessions.block_rows).groupBy("session_id").agg(F.count(F.lit(1)).alias("misplaced"))
    rows = after.groupBy("session_id").agg(F.count(F.lit(1)).alias("rows_out"))
    return rows.join(changed, "session_id", "left").join(moved, "session_id", "left").fillna(0, ["changed", "misplaced"])


REQUESTS = f"""
WITH {S.LONG}, sized AS (SELECT *, {S.ROLE_SIGNAL} AS signal, {S.TOKENS} AS tok, length(text) // 4 AS fz FROM long),
req AS (SELECT session_id, pos AS q, tok AS request_tokens,
               row_number() OVER (PARTITION BY session_id ORDER BY pos) AS request_no
        FROM sized WHERE role = 'user')"""


def replay_sql(quantum: int = 0, half_life: float = 6.0, threshold: float = 0.35) -> str:
    b = f"(q // {quantum}) * {quantum}" if quantum else "q"
    live = S.alive("signal", "b - 1 - pos", half_life, threshold)
    return f"""{REQUESTS}, edges AS (SELECT *, {b} AS b FROM req),
replay_rows AS (SELECT e.*, s.pos, s.tok, s.fz, s.pos >= b AS frozen, s.pos >= b OR {live} AS keep
          FROM edges e LEFT JOIN sized s ON s.session_id = e.session_id AND s.pos < e.q),
replayed AS (
  SELECT session_id, request_no, q AS request_pos, max(request_tokens) AS request_tokens,
    coalesce(sum(CASE WHEN frozen THEN fz ELSE tok END), 0)::BIGINT AS tokens_before,
    coalesce(sum(CASE WHEN frozen THEN fz WHEN keep THEN tok ELSE 0 END), 0)::BIGINT AS tokens_after,
    count(*) FILTER (pos IS NOT NULL AND NOT keep) AS blocks_purged,
    count(*) FILTER (frozen) AS frozen_units
  FROM replay_rows GROUP BY session_id, request_no, q)"""


REPLAY_COLUMNS = """session_id, request_no, request_pos, request_tokens, tokens_before, tokens_after, blocks_purged,
  frozen_units, round(CASE WHEN tokens_before > 0 THEN 1.0 - tokens_after / tokens_before ELSE 0 END, 6) AS reduction"""


@query("request_replay", f"{replay_sql()} SELECT {REPLAY_COLUMNS} FROM replayed")
def request_replay(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(with_long(spark, sf, replay.replay_requests, PruneConfig()), "reduction")


@query("request_replay_quantum", f"{replay_sql(8, 6.0, 0.2)} SELECT {REPLAY_COLUMNS} FROM replayed")
def request_replay_quantum(spark: SparkSession, sf: str) -> DataFrame:
    cfg = AGENT_CONFIG.with_(quantum=8)
    return rounded(with_long(spark, sf, replay.replay_requests, cfg), "reduction")


@query(
    "step_replay",
    f"""WITH {S.LONG}, sized AS (SELECT *, {S.ROLE_SIGNAL} AS signal, {S.TOKENS} AS tok FROM long),
steps AS (SELECT session_id, step, least(4 + (step - 1) * 6, max(n)) AS k
          FROM sized, range(1, 9) r(step) GROUP BY session_id, step),
pairs AS (SELECT t.*, s.tok, {S.alive('signal', 'k - 1 - pos')} AS keep
          FROM steps t JOIN sized s ON s.session_id = t.session_id AND s.pos < t.k)
SELECT session_id, step, k AS history_turns, sum(tok)::BIGINT AS tokens_before,
  coalesce(sum(tok) FILTER (keep), 0)::BIGINT AS tokens_after, count(*) FILTER (NOT keep) AS blocks_purged,
  round(1.0 - coalesce(sum(tok) FILTER (keep), 0) / sum(tok), 6) AS reduction
FROM pairs GROUP BY session_id, step, k""",
)
def step_replay(spark: SparkSession, sf: str) -> DataFrame:
    out = with_long(spark, sf, replay.replay_steps, PruneConfig(), base=4, chunk=6, steps=8)
    return rounded(out, "reduction")


def stability_sql(quantum: int, half_life: float, threshold: float) -> str:
    b = f"(q // {quantum}) * {quantum}" if quantum else "q"
    live = S.alive("signal", "b - 1 - pos", half_life, threshold)
    return f"""{REQUESTS}, edges AS (SELECT *, {b} AS b FROM req),
held AS (SELECT e.session_id, e.request_no, list(s.pos ORDER BY s.pos) AS body
         FROM edges e JOIN sized s ON s.session_id = e.session_id AND s.pos < e.q
         WHERE s.pos >= e.b OR {live} GROUP BY ALL),
lists AS (SELECT r.session_id, r.request_no, coalesce(h.body, []) AS body
          FROM req r LEFT JOIN held h USING (session_id, request_no)),
nexts AS (SELECT *, lead(body) OVER (PARTITION BY session_id ORDER BY request_no) AS nx FROM lists)
SELECT session_id, count(*) AS requests, count(*) FILTER (nx IS NOT NULL AND nx[1:len(body)] <> body) AS invalidations
FROM nexts GROUP BY session_id"""


@query("prefix_stability", stability_sql(0, 6.0, 0.35))
def prefix_stability(spark: SparkSession, sf: str) -> DataFrame:
    return with_long(spark, sf, replay.prefix_stability, PruneConfig())


@query("prefix_stability_quantum", stability_sql(8, 6.0, 0.2))
def prefix_stability_quantum(spark: SparkSession, sf: str) -> DataFrame:
    return with_long(spark, sf, replay.prefix_stability, AGENT_CONFIG.with_(quantum=8))


BLOCK_UNITS = f"""
WITH {S.EVENTS}, f AS (
  SELECT session_id, pos, CASE WHEN event_type = 'error' THEN 'user' ELSE role END AS role, text,
         event_type = 'click' AS has_use, event_type = 'error' AS has_result FROM ev),
o AS (SELECT *, has_use AND coalesce(lead(has_result) OVER w, FALSE) AS opens,
             role = 'user' AND has_result AND coalesce(lag(has_use) OVER w, FALSE) AS answers,
             max(CASE WHEN role = 'user' THEN pos END) OVER (PARTITION BY session_id) AS last_user
      FROM f WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
s AS (SELECT *, CASE WHEN coalesce(lag(opens) OVER (PARTITION BY session_id ORDER BY pos), FALSE) THEN 0 ELSE 1 END AS start,
             last_user - max(CASE WHEN pos = last_user AND answers THEN 1 ELSE 0 END) OVER (PARTITION BY session_id) AS split FROM o),
u AS (SELECT *, sum(start) OVER (PARTITION BY session_id ORDER BY pos) - 1 AS unit_id FROM s)"""


@query("tool_answer_split", f"{BLOCK_UNITS} SELECT session_id, max(split) AS split FROM u GROUP BY session_id")
def tool_answer_split(spark: SparkSession, sf: str) -> DataFrame:
    sessions = block_flags(spark, sf)
    rows = units.split_at_query(sessions.rows, sessions.config(), with_tool_answer=True)
    return rows.groupBy("session_id").agg(F.max("split").alias("split"))


def block_flags(spark: SparkSession, sf: str) -> tables.Sessions:
    """Event sessions in which calls and their output are content blocks."""
    kind = F.col("event_type")

    def flags(rows: DataFrame) -> DataFrame:
        roles = rows.withColumn("role", F.when(kind == "error", "user").otherwise(F.col("role")))
        return units.plain_messages(roles, has_use=kind == "click", has_result=kind == "error")

    return tables.event_sessions(spark, sf, prepare=flags)


BLOCK_DECIDED = f"""{BLOCK_UNITS}, units AS (
  SELECT session_id, unit_id, min(pos) AS first_pos, max(split) AS split, arg_min(role, pos) AS role,
         bool_or(has_use OR has_result) AS is_tool, sum(strlen(text)) + count(*) - 1 AS unit_bytes,
         sum(length(text)) + count(*) - 1 AS unit_chars FROM u GROUP BY session_id, unit_id),
classed AS (
  SELECT *, CASE WHEN role = 'system' THEN 1 WHEN is_tool THEN 16 WHEN role = 'assistant' THEN 4 ELSE 2 END AS signal,
         unit_bytes // 4 + 1 AS tokens, unit_chars // 4 AS frozen_tokens,
         count(*) FILTER (first_pos < split) OVER (PARTITION BY session_id) AS history_units FROM units),
zoned AS (
  SELECT *, history_units // 4 * 4 AS boundary, CASE WHEN split IS NULL THEN 'pass' WHEN first_pos >= split THEN 'tail'
    WHEN unit_id >= history_units // 4 * 4 THEN 'frozen' WHEN unit_id < least(1, history_units // 4 * 4) THEN 'stable' ELSE 'mobile' END AS zone
  FROM classed),
decided AS (SELECT *, zone <> 'mobile' OR {S.alive('signal', 'boundary - 1 - unit_id', 6.0, 0.2)} AS keep FROM zoned)"""


@query("blocks_surface_audit", audit_sql(BLOCK_DECIDED))
def blocks_surface_audit(spark: SparkSession, sf: str) -> DataFrame:
    sessions = block_flags(spark, sf)
    _, decided = units.gateway_plan(sessions.rows, sessions.config(AGENT_CONFIG.with_(quantum=4)), "blocks")
    return rounded(units.unit_audit(decided), "reduction")


@query(
    "multimodal_sizes",
    """WITH m AS (SELECT conv_id, turn, strlen(text) AS b, length(text) AS c, turn % 3 = 0 AS image, turn % 4 = 1 AS call FROM conversations)
SELECT conv_id, turn, ((b + CASE WHEN image THEN 6401 ELSE 0 END + CASE WHEN call THEN 10 ELSE 0 END) // 4 + 1)::BIGINT AS tokens,
  ((c + CASE WHEN image THEN 6401 ELSE 0 END + CASE WHEN call THEN 10 ELSE 0 END) // 4)::BIGINT AS frozen_tokens FROM m""",
)
def multimodal_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as structured messages: text parts, every third turn with an image, some with a tool call."""

    def part(kind: str, text) -> object:
        return F.struct(
            F.lit(kind).alias("type"),
            text.cast("string").alias("text"),
            F.lit(None).cast("boolean").alias("cache_control"),
            F.lit(None).cast("string").alias("id"),
            F.lit(None).cast("string").alias("tool_use_id"),
        )

    image = F.col("turn") % 3 == 0
    calls = F.array(F.struct(F.lit("1").alias("id"), F.lit('{"f": 1}x').alias("function")))
    rows = tables.table(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("pos"),
        "role",
        F.when(~image, F.col("text")).alias("content"),
        F.when(image, F.array(part("text", F.col("text")), part("image", F.lit(None)))).alias("parts"),
        F.when(F.col("turn") % 4 == 1, calls).alias("tool_calls"),
    )
    flat = units.flatten_messages(rows)
    newlines = F.greatest(F.col("size_pieces") - 1, F.lit(0))
    return flat.select(
        F.col("session_id").alias("conv_id"),
        F.col("pos").alias("turn"),
        T.token_size_of_bytes(F.col("size_bytes") + newlines).alias("tokens"),
        F.floor((F.col("size_chars") + newlines) / 4).cast("bigint").alias("frozen_tokens"),
    )
