"""Audit log, live numbers, ledgers and estimates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import dims
from palimpsest.config import PruneConfig
from palimpsest.functions import display
from palimpsest.functions.energy import BOUNDS
from palimpsest.operators import audit as A
from palimpsest.operators import ledger as L
from palimpsest.operators.lineage import cut
from palimpsest.operators import prune, replay, scans, units
from palimpsest.plans.pruning import (
    AUDIT_COLUMNS,
    DECIDED,
    ev_flags,
    long_signals,
    replay_sql,
    rounded,
    zoned_sql,
    UNIT_AUDIT,
)
from palimpsest.plans.registry import query
from palimpsest.plans.scans import effort_sql
from palimpsest.sources import audit_log as log
from palimpsest.sources import tables, unit_store
from palimpsest.streaming.sinks import scratch

MODELS = [m for m, *_ in dims.ROSTER]
MODELS_SQL = "[" + ", ".join(f"'{m}'" for m in MODELS) + "]"
BASE_SECONDS = 1767225600


def audit_frame(spark: SparkSession, sf: str) -> tables.Sessions:
    """The audit log that the replayed requests of the long sessions would have left.

    A deployment holds at most four of the ten sessions, so it fits a task whenever they do.
    """
    sessions = long_signals(spark, sf)
    requests = replay.replay_requests(sessions.rows, sessions.config())
    seq = F.col("request_no") * 10 + F.col("session_id")
    named = requests.withColumns(
        {
            "seq": seq,
            "deployment": F.concat(F.lit("site-"), (F.col("session_id") % 3).cast("string")),
        }
    )
    rows = log.audit_rows(
        named,
        ts=F.date_format(F.timestamp_seconds(F.lit(BASE_SECONDS) + seq * 7), "yyyy-MM-dd'T'HH:mm:ss"),
        model=F.get(F.array(*[F.lit(m) for m in MODELS]), (F.col("request_no") % len(MODELS)).cast("int")),
        stream=F.col("request_no") % 2 == 0,
        latency=(F.col("request_pos") * 7 % 100) / 10.0,
    )
    return sessions.with_rows(rows)


AUDIT = f"""{replay_sql()}, audit AS (
  SELECT request_no * 10 + session_id AS seq, 'site-' || (session_id % 3) AS deployment,
    strftime(make_timestamp((({BASE_SECONDS} + (request_no * 10 + session_id) * 7) * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%S') AS ts,
    {MODELS_SQL}[(request_no % 8 + 1)::INT] AS model, request_no % 2 = 0 AS stream, tokens_before, tokens_after,
    round(CASE WHEN tokens_before > 0 THEN 1.0 - tokens_after / tokens_before ELSE 0 END, 4) AS reduction,
    (request_pos * 7 % 100) / 10.0::DOUBLE AS kernel_latency_us, blocks_purged
  FROM replayed)"""

ROLLUP = """count(*) AS requests, sum(tokens_before)::BIGINT AS tokens_before, sum(tokens_after)::BIGINT AS tokens_after,
  (sum(tokens_before) - sum(tokens_after))::BIGINT AS tokens_saved,
  round(CASE WHEN sum(tokens_before) > 0 THEN 1.0 - sum(tokens_after) / sum(tokens_before) ELSE 0 END, 6) AS reduction"""


@query("audit_log_rows", f"""{AUDIT}
SELECT seq, deployment, ts, model, stream, tokens_before, tokens_after, round(reduction, 4) AS reduction,
  kernel_latency_us, blocks_purged, NULL::BOOLEAN AS held, NULL::DOUBLE AS potential_reduction, NULL::VARCHAR AS effort_tier, NULL::BIGINT AS hashes FROM audit""")
def audit_log_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit_frame(spark, sf).rows
    return rows.select(
        *[c for c in rows.columns if c not in ("effort", "purged_hashes")], F.col("effort.tier").alias("effort_tier"),
        F.when(F.col("purged_hashes").isNotNull(), F.size("purged_hashes")).cast("bigint").alias("hashes"),
    )


@query("audit_rollup", f"{AUDIT} SELECT deployment, substring(ts, 1, 10) AS day, {ROLLUP} FROM audit GROUP BY ALL")
def audit_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit_frame(spark, sf).rows
    return rounded(A.rollup(rows, ["deployment", F.substring("ts", 1, 10).alias("day")]), "reduction")


@query("audit_session_totals", f"""{AUDIT}
SELECT deployment, count(*) AS requests, sum(tokens_before)::BIGINT AS tokens_before,
  sum(tokens_after)::BIGINT AS tokens_after, sum(blocks_purged)::BIGINT AS blocks_purged,
  max(reduction) AS peak_reduction FROM audit GROUP BY deployment""")
def audit_session_totals(spark: SparkSession, sf: str) -> DataFrame:
    return A.session_totals(audit_frame(spark, sf).rows, ["deployment"])


@query("audit_model_totals", f"{AUDIT} SELECT model, {ROLLUP} FROM audit GROUP BY model")
def audit_model_totals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.model_totals(audit_frame(spark, sf).rows), "reduction")


@query("top_models", f"{AUDIT} SELECT model, {ROLLUP} FROM audit GROUP BY model ORDER BY tokens_saved DESC, model LIMIT 8")
def top_models(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(A.top_models(audit_frame(spark, sf).rows), "reduction")


@query("latest_requests", f"""{AUDIT}
SELECT deployment, seq, ts, model, tokens_before, tokens_after FROM audit ORDER BY ts DESC, deployment, seq DESC LIMIT 10""")
def latest_requests(spark: SparkSession, sf: str) -> DataFrame:
    order = [F.desc("ts"), F.asc("deployment"), F.desc("seq")]
    rows = A.latest_requests(audit_frame(spark, sf).rows, order)
    return rows.select("deployment", "seq", "ts", "model", "tokens_before", "tokens_after")


@query("rolling_latency", f"""{AUDIT}, w AS (
  SELECT deployment, seq, kernel_latency_us, reduction,
    list_sort(list(kernel_latency_us) OVER f) AS vals, avg(reduction) OVER f AS mean_reduction
  FROM audit WINDOW f AS (PARTITION BY deployment ORDER BY seq ROWS BETWEEN 239 PRECEDING AND CURRENT ROW))
SELECT deployment, seq, vals[len(vals) // 2 + 1] AS latency_p50, vals[len(vals)] AS latency_max,
  round(mean_reduction, 6) AS mean_reduction, len(vals)::BIGINT AS window_rows FROM w""")
def rolling_latency(spark: SparkSession, sf: str) -> DataFrame:
    frame = audit_frame(spark, sf)
    out = A.rolling_stats(frame.rows, ["deployment"], "seq", block_rows=frame.block_rows)
    return rounded(
        out.select("deployment", "seq", "latency_p50", "latency_max", "mean_reduction", "window_rows"), "mean_reduction"
    )


@query("thinned_curve", f"""{AUDIT}, c AS (
  SELECT deployment, seq, tokens_before, tokens_after,
    row_number() OVER (PARTITION BY deployment ORDER BY seq) AS row_no, count(*) OVER (PARTITION BY deployment) AS n FROM audit)
SELECT deployment, seq, row_no, tokens_before, tokens_after FROM c
WHERE (row_no - 1) % greatest(n // 12, 1) = 0 OR row_no = n""")
def thinned_curve(spark: SparkSession, sf: str) -> DataFrame:
    frame = audit_frame(spark, sf)
    out = A.thin_curve(frame.rows, ["deployment"], "seq", block_rows=frame.block_rows)
    return out.select("deployment", "seq", "row_no", "tokens_before", "tokens_after")


@query("dashboard_levels", f"""{AUDIT}
SELECT deployment, seq,
  trunc(reduction * 1000) / 10 AS percent, least(floor(least(greatest(reduction, 0), 1) * 8), 7)::BIGINT AS level FROM audit""")
def dashboard_levels(spark: SparkSession, sf: str) -> DataFrame:
    return audit_frame(spark, sf).rows.select(
        "deployment",
        "seq",
        display.truncated_percent(F.col("reduction")).alias("percent"),
        display.level(F.col("reduction")).alias("level"),
    )


ESTIMATES_SQL = ", ".join(
    f"round(greatest(tokens_saved, 0) / 1e6 * {k} * 1000.0, 6) AS wh_{b}" for b, k in dims.KWH_PER_MTOK.items()
) + ", " + ", ".join(
    f"round(greatest(tokens_saved, 0) / 1e6 * {k} * 445.0, 6) AS gco2e_{b}" for b, k in dims.KWH_PER_MTOK.items()
)
ESTIMATE_NAMES = [f"{p}_{b}" for p in ("wh", "gco2e") for b in BOUNDS]


@query("saving_estimates", f"""{AUDIT}, t AS (SELECT deployment, {ROLLUP} FROM audit GROUP BY deployment)
SELECT *, {ESTIMATES_SQL}, CASE WHEN tokens_saved > 0 THEN round(tokens_saved / 1e6 * 2.0, 6) END AS usd_avoided FROM t""")
def saving_estimates(spark: SparkSession, sf: str) -> DataFrame:
    totals = A.rollup(audit_frame(spark, sf).rows, ["deployment"])
    return rounded(A.estimates(totals, price_in=2.0), "reduction", "usd_avoided", *ESTIMATE_NAMES)


@query("cached_saving_estimates", f"""{AUDIT}, t AS (SELECT model, {ROLLUP} FROM audit GROUP BY model)
SELECT model, tokens_saved, round(tokens_saved / 1e6 * 0.9 * 1000.0 * 0.325, 6) AS wh_mid,
  round(tokens_saved / 1e6 * 0.9 * 0.325 * 100.0, 6) AS gco2e_mid FROM t""")
def cached_saving_estimates(spark: SparkSession, sf: str) -> DataFrame:
    totals = A.model_totals(audit_frame(spark, sf).rows)
    out = A.estimates(totals, grid="br", cache_hit=0.75, cache_cost=0.10)
    return rounded(out.select("model", "tokens_saved", "wh_mid", "gco2e_mid"), "wh_mid", "gco2e_mid")


@query("energy_per_request", f"""{AUDIT}, t AS (SELECT model, {ROLLUP} FROM audit WHERE model <> '{MODELS[0]}' GROUP BY model),
a AS (SELECT model, tokens_before, tokens_after, reduction, coalesce(tokens_before, 0) > 0 AS valid FROM (SELECT unnest({MODELS_SQL}) AS model) LEFT JOIN t USING (model))
SELECT model, valid, CASE WHEN valid THEN reduction END AS reduction,
  {', '.join(f"CASE WHEN valid THEN round(tokens_before / 1e6 * {k} * 1000.0, 6) END AS wh_before_{b}, CASE WHEN valid THEN round(tokens_after / 1e6 * {k} * 1000.0, 6) END AS wh_after_{b}" for b, k in dims.KWH_PER_MTOK.items())}
FROM a""")
def energy_per_request(spark: SparkSession, sf: str) -> DataFrame:
    """All priced models; one without requests has no energy."""
    audit = audit_frame(spark, sf).rows.filter(F.col("model") != MODELS[0])
    totals = F.broadcast(dims.roster(spark).select("model")).join(A.model_totals(audit), "model", "left")
    names = [f"wh_{side}_{b}" for side in ("before", "after") for b in BOUNDS]
    return rounded(A.energy_per_request(totals, strict=False).select("model", "valid", "reduction", *names), "reduction", *names)


@query("grid_coefficients", f"""{AUDIT}, t AS (SELECT {ROLLUP} FROM audit),
g(grid, g_per_kwh) AS (VALUES ('world', 445.0::DOUBLE), ('eu', 230.0), ('us', 385.0), ('br', 100.0)),
c(bound, k) AS (VALUES ('low', 0.5::DOUBLE), ('mid', 0.9), ('high', 1.3))
SELECT grid, bound, round(tokens_saved / 1e6 * k * 1000.0, 6) AS wh,
  round(tokens_saved / 1e6 * k * g_per_kwh, 6) AS gco2e FROM t, g, c""")
def grid_coefficients(spark: SparkSession, sf: str) -> DataFrame:
    totals = A.rollup(audit_frame(spark, sf).rows)
    every = totals.crossJoin(F.broadcast(dims.grids(spark))).crossJoin(F.broadcast(dims.coefficients(spark)))
    energy = F.col("tokens_saved") / 1e6 * F.col("kwh_per_mtok")
    return every.select(
        "grid",
        "bound",
        F.round(energy * 1000.0, 6).alias("wh"),
        F.round(energy * F.col("g_per_kwh"), 6).alias("gco2e"),
    )


@query("deployment_projection", f"""{AUDIT}, t AS (SELECT {ROLLUP} FROM audit),
y AS (SELECT floor(tokens_saved::DOUBLE / requests * 100000 * 365)::BIGINT AS tokens_per_year FROM t),
g(grid, g_per_kwh) AS (VALUES ('world', 445.0::DOUBLE), ('eu', 230.0), ('us', 385.0), ('br', 100.0))
SELECT grid, tokens_per_year, {', '.join(f"round(tokens_per_year / 1e6 * {k} * 1000.0 * 0.325 / 1e6, 6) AS mwh_{b}, round(tokens_per_year / 1e6 * {k} * 1000.0 * 0.325 / 1e9 * g_per_kwh, 6) AS tco2e_{b}" for b, k in dims.KWH_PER_MTOK.items())}
FROM y, g""")
def deployment_projection(spark: SparkSession, sf: str) -> DataFrame:
    totals = A.rollup(audit_frame(spark, sf).rows)
    out = A.deployment_projection(totals, dispatches_per_day=100_000, cache_hit=0.75)
    names = [f"{p}_{b}" for p in ("mwh", "tco2e") for b in BOUNDS]
    return rounded(out.select("grid", "tokens_per_year", *names), *names)


CHAIN = f"""{AUDIT}, pieces AS (
  SELECT deployment, seq, ts, model, tokens_before, tokens_after,
    '{{"model":"' || model || '","prev_hash":"@","tokens_after":' || tokens_after || ',"tokens_before":' || tokens_before
      || ',"ts":"' || ts || '"}}' AS piece,
    row_number() OVER (PARTITION BY deployment ORDER BY seq) AS no FROM audit),
folded AS (
  SELECT *, list(piece) OVER (PARTITION BY deployment ORDER BY seq) AS upto FROM pieces),
hashed AS (
  SELECT deployment, seq, ts, model, tokens_before, tokens_after,
    list_reduce(upto, lambda h, p: sha256(replace(p, '@', h)), 'GENESIS') AS hash FROM folded),
chained AS (
  SELECT *, coalesce(lag(hash) OVER (PARTITION BY deployment ORDER BY seq), 'GENESIS') AS prev_hash FROM hashed)"""


@query("hash_chain", f"""{CHAIN}
SELECT deployment, 0::BIGINT AS segment, seq, ts, model, tokens_before, tokens_after, prev_hash, hash FROM chained""")
def hash_chain(spark: SparkSession, sf: str) -> DataFrame:
    return L.chain(audit_frame(spark, sf).rows)


SEGMENTED = CHAIN.replace("PARTITION BY deployment ORDER BY seq", "PARTITION BY deployment, seq // 64 ORDER BY seq")


SEALED = f"""{SEGMENTED}, h AS (
  SELECT deployment, seq // 64 AS segment, arg_max(hash, seq) AS head, count(*) AS n, min(seq) AS lo, max(seq) AS hi FROM chained GROUP BY ALL)"""


@query("hash_chain_heads", f"""{SEALED},
l AS (SELECT deployment, list(concat_ws('|', '', segment, n, lo, hi, head) ORDER BY segment) AS heads, sum(n)::BIGINT AS chain_rows
  FROM h GROUP BY deployment)
SELECT deployment, len(heads)::BIGINT AS segments, chain_rows, list_reduce(heads, lambda a, x: sha256(a || x), 'GENESIS') AS chain_head FROM l""")
def hash_chain_heads(spark: SparkSession, sf: str) -> DataFrame:
    return L.chain_heads(L.seal(L.segment_heads(in_segments(spark, sf))))


def in_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Chains in segments of 64 sequence numbers, computed once."""
    return cut(L.chain(audit_frame(spark, sf).rows, segment=F.floor(F.col("seq") / 64)))


# What is left after rows were lost: per segment what the stored list says and what the rows say.
def lost_sql(lost: str) -> str:
    return f"""{SEALED}, left_over AS (SELECT * FROM chained WHERE NOT ({lost})),
g AS (SELECT deployment, seq // 64 AS segment, arg_max(hash, seq) AS head, count(*) AS n, min(seq) AS lo FROM left_over GROUP BY ALL),
c AS (SELECT deployment, min(h.lo) FILTER (g.head IS NULL OR g.head <> h.head OR g.n <> h.n) AS first_broken
  FROM h LEFT JOIN g USING (deployment, segment) GROUP BY deployment),
r AS (SELECT deployment, min(seq) FILTER (prev_hash <> coalesce(before, 'GENESIS')) AS first_broken, arg_max(hash, seq) AS last_hash, count(*) AS requests
  FROM (SELECT *, lag(hash) OVER (PARTITION BY deployment, seq // 64 ORDER BY seq) AS before FROM left_over) GROUP BY deployment)
SELECT deployment, least(c.first_broken, r.first_broken) IS NULL AS ok, least(c.first_broken, r.first_broken) AS first_broken, last_hash, requests
FROM c JOIN r USING (deployment)"""


@query("chain_verification_deleted_segment", lost_sql("deployment = 'site-1' AND seq // 64 = 1"))
def chain_verification_deleted_segment(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of one segment are gone."""
    rows = in_segments(spark, sf)
    lost = (F.col("deployment") == "site-1") & (F.col("segment") == 1)
    return L.verify(rows.filter(~lost), sealed=cut(L.seal(L.segment_heads(rows))))


@query("chain_verification_cut_segment", lost_sql("deployment = 'site-0' AND seq // 64 = 0 AND seq >= 50"))
def chain_verification_cut_segment(spark: SparkSession, sf: str) -> DataFrame:
    """The end of an inner segment is gone."""
    rows = in_segments(spark, sf)
    lost = (F.col("deployment") == "site-0") & (F.col("segment") == 0) & (F.col("seq") >= 50)
    return L.verify(rows.filter(~lost), sealed=cut(L.seal(L.segment_heads(rows))))


def tampered(spark: SparkSession, sf: str) -> DataFrame:
    """The chain after someone changed one count in one deployment."""
    hit = (F.col("deployment") == "site-1") & (F.col("seq") == 51)
    rows = L.chain(audit_frame(spark, sf).rows)
    return rows.withColumn("tokens_after", F.when(hit, F.col("tokens_after") + 1).otherwise(F.col("tokens_after")))


@query("chain_verification", f"""{CHAIN}, t AS (
  SELECT * REPLACE (CASE WHEN deployment = 'site-1' AND seq = 51 THEN tokens_after + 1 ELSE tokens_after END AS tokens_after)
  FROM chained),
r AS (SELECT *, prev_hash <> coalesce(lag(hash) OVER (PARTITION BY deployment ORDER BY seq), 'GENESIS') OR hash <> sha256(
    '{{"model":"' || model || '","prev_hash":"' || prev_hash || '","tokens_after":' || tokens_after || ',"tokens_before":'
    || tokens_before || ',"ts":"' || ts || '"}}') AS broken FROM t)
SELECT deployment, NOT bool_or(broken) AS ok, min(seq) FILTER (broken) AS first_broken, arg_max(hash, seq) AS last_hash,
  count(*) AS requests FROM r GROUP BY deployment""")
def chain_verification(spark: SparkSession, sf: str) -> DataFrame:
    return L.verify(tampered(spark, sf))


@query("long_chain_verification", f"""{CHAIN},
r AS (SELECT *, prev_hash <> coalesce(lag(hash) OVER (PARTITION BY deployment ORDER BY seq), 'GENESIS') OR hash <> sha256(
    '{{"model":"' || model || '","prev_hash":"' || prev_hash || '","tokens_after":' || tokens_after || ',"tokens_before":'
    || tokens_before || ',"ts":"' || ts || '"}}') AS broken FROM chained)
SELECT deployment, NOT bool_or(broken) AS ok, min(seq) FILTER (broken) AS first_broken, arg_max(hash, seq) AS last_hash, count(*) AS requests
FROM r GROUP BY deployment""")
def long_chain_verification(spark: SparkSession, sf: str) -> DataFrame:
    return L.verify(L.chain(audit_frame(spark, sf).rows), block_rows=32)


LEDGER = f"""{CHAIN}, s AS (
  SELECT deployment, count(*) AS requests, sum(tokens_before)::BIGINT AS before, sum(tokens_after)::BIGINT AS after,
    (sum(tokens_before) - sum(tokens_after))::BIGINT AS tokens_saved, arg_max(hash, seq) AS chain_head
  FROM chained GROUP BY deployment)"""


@query("carbon_ledger", f"""{LEDGER}
SELECT deployment, requests, before, after, tokens_saved AS saved, round(100.0 * (1 - after / before), 4) AS input_reduction_pct,
  CASE WHEN tokens_saved > 0 THEN round(tokens_saved / 1e6 * 2.0, 6) END AS usd_input_avoided, {ESTIMATES_SQL.replace('445.0', '100.0')}, chain_head,
  1::BIGINT AS segments, 'carbon_ledger/1' AS schema, '2026-01' AS period, 'br' AS grid, 100.0::DOUBLE AS grid_g_per_kwh,
  'esg-1.0' AS coefficient_version FROM s""")
def carbon_ledger(spark: SparkSession, sf: str) -> DataFrame:
    built = L.build_ledger(L.chain(audit_frame(spark, sf).rows), grid="br", price_in=2.0, period="2026-01")
    return rounded(built, *ESTIMATE_NAMES)


def _again(sql: str) -> str:
    """The CTEs of a chain once more, over audit_2."""
    return re.sub(r"\b(audit|pieces|folded|hashed|chained)\b", r"\1_2", sql.removeprefix(AUDIT))


@query("ledger_comparison", f"""{CHAIN}, audit_2 AS (SELECT * REPLACE (tokens_before + CASE WHEN deployment = 'site-2' AND seq % 7 = 1 THEN 1000 ELSE 0 END AS tokens_before) FROM audit){_again(CHAIN)},
a AS (SELECT deployment, sum(tokens_before) AS x, sum(tokens_after) AS y, arg_max(hash, seq) AS head FROM chained GROUP BY deployment),
b AS (SELECT deployment, sum(tokens_before) AS x, sum(tokens_after) AS y, arg_max(hash, seq) AS head FROM chained_2 GROUP BY deployment),
c AS (SELECT deployment, a.x = b.x AS before_ok, a.y = b.y AS after_ok, round(100.0 * (1 - a.y / a.x), 4) = round(100.0 * (1 - b.y / b.x), 4) AS input_reduction_pct_ok,
  a.head = b.head AS chain_head_ok FROM a JOIN b USING (deployment))
SELECT *, before_ok AND after_ok AND input_reduction_pct_ok AND chain_head_ok AS ok FROM c""")
def ledger_comparison(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit_frame(spark, sf).rows
    stored = L.build_ledger(L.chain(rows))
    hit = (F.col("deployment") == "site-2") & (F.col("seq") % 7 == 1)
    changed = rows.withColumn("tokens_before", F.col("tokens_before") + F.when(hit, 1000).otherwise(0))
    return L.compare_ledgers(stored, L.build_ledger(L.chain(changed)))


@query("ledger_documents", f"""{LEDGER}
SELECT deployment, before, after, tokens_saved AS saved, round(tokens_saved / 1e6 * 0.9 * 1000.0, 6) AS wh_mid, chain_head, 'world' AS grid FROM s""")
def ledger_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Ledgers written as JSON documents and read back."""
    path = scratch(spark, "ledger")
    built = L.build_ledger(L.chain(audit_frame(spark, sf).rows))
    L.write_ledger(built, path)
    back = spark.read.schema(L.ledger_documents(built).schema).json(path)
    return back.select(
        "deployment", "tokens.before", "tokens.after", "tokens.saved", F.round(F.get("wh_avoided", F.lit(1)), 6).alias("wh_mid"), "chain_head", "grid"
    )


PURGED_UNITS = f"""{zoned_sql(0, "0", 6.0, 0.35)}, docs AS (
  SELECT d.session_id, d.unit_id::BIGINT AS unit_id,
    '[' || string_agg('{{"content":' || to_json(u.text) || ',"role":"' || u.role || '"}}', ',' ORDER BY u.pos) || ']' AS unit
  FROM decided d JOIN u USING (session_id, unit_id) WHERE NOT d.keep GROUP BY ALL),
hashed AS (SELECT *, sha256(unit) AS digest FROM docs)"""


def purged_documents(spark: SparkSession, sf: str) -> DataFrame:
    sessions = ev_flags(spark, sf)
    grouped, decided = units.gateway_plan(sessions.rows, sessions.config())
    return unit_store.unit_documents(units.purged_messages(grouped, decided, sessions.rows))


@query("purged_unit_documents", f"{PURGED_UNITS} SELECT session_id, unit_id, unit, digest FROM hashed")
def purged_unit_documents(spark: SparkSession, sf: str) -> DataFrame:
    return purged_documents(spark, sf).select("session_id", "unit_id", "unit", "digest")


DIGEST_LOG = f"""{zoned_sql(8, "3", 6.0, 0.35)}, audit AS ({UNIT_AUDIT}),
pot AS (SELECT *, CASE WHEN tokens_before > 0 THEN 1.0 - tokens_after / tokens_before ELSE 0 END AS potential FROM audit),
h AS (SELECT *, potential < 0.55 AS held FROM pot),
docs AS (
  SELECT d.session_id, d.unit_id::BIGINT AS unit_id,
    '[' || string_agg('{{"content":' || to_json(u.text) || ',"role":"' || u.role || '"}}', ',' ORDER BY u.pos) || ']' AS unit
  FROM decided d JOIN u USING (session_id, unit_id) WHERE NOT d.keep GROUP BY ALL),
lists AS (SELECT session_id, string_agg(sha256(unit), ',' ORDER BY unit_id) AS hashes FROM docs GROUP BY session_id),
last AS (SELECT session_id AS id, arg_max(text, pos) AS text FROM u WHERE role = 'user' GROUP BY session_id)"""


@query("audit_log_with_digests", f"""{DIGEST_LOG}, e AS ({effort_sql("SELECT id, text FROM last")} SELECT id, tier, round(s::DOUBLE, 4) AS score FROM scored)
SELECT session_id AS seq, 'm' AS model, TRUE AS stream, tokens_before, CASE WHEN held THEN tokens_before ELSE tokens_after END AS tokens_after,
  round(CASE WHEN held THEN 0 ELSE potential END, 4)::DOUBLE AS reduction, 0.0::DOUBLE AS kernel_latency_us, CASE WHEN held THEN 0 ELSE blocks_purged END AS blocks_purged,
  CASE WHEN held THEN TRUE END AS held, CASE WHEN held THEN round(potential, 4) END::DOUBLE AS potential_reduction,
  tier AS effort_tier, score AS effort_score, CASE WHEN NOT held THEN hashes END AS purged_hashes
FROM h LEFT JOIN lists USING (session_id) LEFT JOIN e ON e.id = session_id""")
def audit_log_with_digests(spark: SparkSession, sf: str) -> DataFrame:
    """The log of one request per session: written with all its fields, next to the store of what was purged, and read back."""
    sessions = ev_flags(spark, sf)
    sessions = sessions.with_rows(cut(sessions.rows.select(*units.NARROW, "text")))  # numbered once; four steps read them
    grouped, decided = units.gateway_plan(sessions.rows, sessions.config(PruneConfig(stable_prefix=3, quantum=8, hysteresis=0.55)))
    decided = cut(decided)
    documents = cut(unit_store.unit_documents(units.purged_messages(grouped, decided, sessions.rows)))
    root = scratch(spark, "digest-log")
    unit_store.append_units(documents, f"{root}/units")
    lists = unit_store.whole_lists(unit_store.session_digests(documents))
    asked = sessions.rows.filter("role = 'user'").groupBy("session_id").agg(F.max_by("text", "pos").alias("text"))
    effort = scans.effort(asked).select("session_id", F.struct("tier", F.round(F.col("score").cast("double"), 4).alias("score"), F.lit("none").alias("action")).alias("effort"))
    # ties go away from zero, as in the SQL; the log rounds to even
    saved = F.round(prune.reduction(F.max("session_before"), F.max("session_after")), 4).alias("saved")
    rows = units.unit_audit(decided).join(decided.groupBy("session_id").agg(saved), "session_id", "left").join(lists, "session_id", "left").join(effort, "session_id", "left")
    rows = rows.withColumns({"seq": F.col("session_id"), "reduction": F.when(F.col("held"), 0.0).otherwise(F.coalesce("saved", "reduction")), "potential_reduction": F.when(F.col("held"), F.coalesce("saved", "potential_reduction"))})
    log.write_audit(log.audit_rows(rows, ts=F.lit("2026-01-01T00:00:00"), model=F.lit("m"), stream=F.lit(True)), f"{root}/log", partition_by_day=False)
    back = log.read_audit(spark, f"{root}/log")
    hashes = back.select("seq", F.explode("purged_hashes").alias("digest"))
    known = unit_store.rehydrate(hashes, unit_store.read_units(spark, f"{root}/units"))
    listed = known.filter("status = 'found'").groupBy("seq").agg(F.count(F.lit(1)).alias("found"))
    told = back.join(listed, "seq", "left")
    return told.select(
        "seq", "model", "stream", "tokens_before", "tokens_after", "reduction", "kernel_latency_us", "blocks_purged", "held", "potential_reduction",
        F.col("effort.tier").alias("effort_tier"), F.col("effort.score").alias("effort_score"),
        F.when(F.size("purged_hashes") == F.col("found"), F.array_join("purged_hashes", ",")).alias("purged_hashes"),
    )


@query("purged_unit_store", f"{PURGED_UNITS} SELECT DISTINCT digest, unit FROM hashed")
def purged_unit_store(spark: SparkSession, sf: str) -> DataFrame:
    return unit_store.new_units(purged_documents(spark, sf), None)


@query("hibernation_use", f"{PURGED_UNITS} SELECT count(*) AS \"references\", count(DISTINCT digest) AS unique_units FROM hashed")
def hibernation_use(spark: SparkSession, sf: str) -> DataFrame:
    return A.hibernation_use(unit_store.session_digests(purged_documents(spark, sf)))


@query("rehydration_lookup", f"""{PURGED_UNITS}, refs AS (
  SELECT session_id, unit_id, CASE WHEN unit_id % 11 = 0 THEN 'short' WHEN unit_id % 7 = 0 THEN reverse(digest) ELSE digest END
    AS digest FROM hashed),
store AS (SELECT DISTINCT digest, unit FROM hashed)
SELECT r.session_id, r.unit_id, r.digest, s.unit, CASE WHEN NOT regexp_full_match(r.digest, '[0-9a-f]{{64}}') THEN 'invalid'
  WHEN s.digest IS NULL THEN 'unknown' ELSE 'found' END AS status FROM refs r LEFT JOIN store s USING (digest)""")
def rehydration_lookup(spark: SparkSession, sf: str) -> DataFrame:
    docs = purged_documents(spark, sf)
    unit = F.col("unit_id")
    asked = F.when(unit % 11 == 0, "short").when(unit % 7 == 0, F.reverse("digest")).otherwise(F.col("digest"))
    refs = docs.select("session_id", "unit_id", asked.alias("digest"))
    return unit_store.rehydrate(refs, unit_store.new_units(docs, None))


@query("config_comparison", f"""{DECIDED}, c AS (SELECT 'all' AS scope, {AUDIT_COLUMNS} FROM decided),
t AS (SELECT *, {"{}"} AS keep2 FROM decided), d AS (
  SELECT 'all' AS scope, sum(tok)::BIGINT AS tokens_before, coalesce(sum(tok) FILTER (keep2), 0)::BIGINT AS tokens_after FROM t)
SELECT c.scope, c.tokens_before AS tokens_before_control, d.tokens_before AS tokens_before_tuned,
  c.tokens_after AS tokens_after_control, d.tokens_after AS tokens_after_tuned, 0.0::DOUBLE AS tokens_before_change,
  round((d.tokens_after - c.tokens_after) / c.tokens_after, 6) AS tokens_after_change FROM c JOIN d USING (scope)""".replace(
    "{}", "signal & 9 <> 0 OR pos < 4 OR 1.0 * pow(2.0, -age / 6.0) >= 0.2"))
def config_comparison(spark: SparkSession, sf: str) -> DataFrame:
    rows = long_signals(spark, sf).rows

    def totals(cfg: PruneConfig) -> DataFrame:
        per_session = prune.session_audit(prune.decide(rows, cfg))
        return A.rollup(per_session, [F.lit("all").alias("scope")])

    out = A.compare_configs(
        totals(PruneConfig()),
        totals(PruneConfig(threshold=0.2, stable_prefix=4)),
        ["scope"],
        ["tokens_before", "tokens_after"],
    )
    return rounded(out, "tokens_after_change", "tokens_before_change")
