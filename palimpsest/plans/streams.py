"""Streaming queries, run to the end of the available data; their SQL is that of the batch twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import AGENT_CONFIG
from palimpsest.operators import repair, units
from palimpsest.operators.sequence import Layout
from palimpsest.plans.audits import AUDIT, CHAIN, audit_frame
from palimpsest.plans.pruning import BLOCK_DECIDED, block_flags, rounded
from palimpsest.plans.registry import query
from palimpsest.plans.scans import DECAY, FLOOD, cycle_rows
from palimpsest.plans.signals import EVENTS
from palimpsest.sources import audit_log as log
from palimpsest.sources import tables
from palimpsest.streaming import audit_stream, ledger_stream, session_state, signal_stream
from palimpsest.streaming.sinks import append_to_table, latest_to_table, scratch


def audit_folder(spark: SparkSession, sf: str) -> str:
    """The audit log as JSON files, the way a gateway would drop them."""
    path = scratch(spark, "audit-log")
    rows = audit_frame(spark, sf).rows
    files = rows.repartitionByRange(4, "seq")
    log.write_audit(files, path, partition_by_day=False)
    return path


@query("stream_audit_follow", f"""{AUDIT} SELECT seq, deployment, ts, model, tokens_before, tokens_after, blocks_purged FROM audit""")
def stream_audit_follow(spark: SparkSession, sf: str) -> DataFrame:
    rows = append_to_table(audit_stream.follow_audit(spark, audit_folder(spark, sf), files_per_batch=2), "follow")
    return rows.select("seq", "deployment", "ts", "model", "tokens_before", "tokens_after", "blocks_purged")


@query("audit_log_scan", f"""{AUDIT} SELECT seq, ts, model, tokens_before, tokens_after FROM audit""")
def audit_log_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = log.read_audit(spark, audit_folder(spark, sf), sized_only=True)
    return rows.select("seq", "ts", "model", "tokens_before", "tokens_after")


@query("stream_totals", f"""{AUDIT} SELECT count(*) AS requests, sum(tokens_before)::BIGINT AS tokens_before, sum(tokens_after)::BIGINT AS tokens_after,
  sum(blocks_purged)::BIGINT AS blocks_purged, max(reduction) AS peak_reduction FROM audit""")
def stream_totals(spark: SparkSession, sf: str) -> DataFrame:
    stream = audit_stream.follow_audit(spark, audit_folder(spark, sf), files_per_batch=2)
    return latest_to_table(audit_stream.live_totals(stream), "totals")


@query("stream_model_totals", f"""{AUDIT} SELECT model, count(*) AS requests, sum(tokens_before)::BIGINT AS tokens_before, sum(tokens_after)::BIGINT AS tokens_after,
  (sum(tokens_before) - sum(tokens_after))::BIGINT AS tokens_saved,
  round(CASE WHEN sum(tokens_before) > 0 THEN 1.0 - sum(tokens_after) / sum(tokens_before) ELSE 0 END, 6) AS reduction FROM audit GROUP BY model""")
def stream_model_totals(spark: SparkSession, sf: str) -> DataFrame:
    stream = audit_stream.follow_audit(spark, audit_folder(spark, sf), files_per_batch=2)
    return rounded(latest_to_table(audit_stream.live_model_totals(stream), "models"), "reduction")


def closed_folder(spark: SparkSession, sf: str) -> str:
    """The audit log with the row of a gateway that goes down, as the last file."""
    path = audit_folder(spark, sf)
    rows = log.read_audit(spark, path)
    audit_stream.closing_row(rows, 120).coalesce(1).write.mode("append").json(path)
    return path


@query("stream_request_rate", f"""{AUDIT}, t AS (SELECT epoch(strptime(ts, '%Y-%m-%dT%H:%M:%S'))::BIGINT AS second FROM audit),
w AS (SELECT second // 5 * 5 - k * 5 AS start_s FROM t, range(0, 12) r(k))
SELECT start_s, count(*) AS requests FROM w GROUP BY start_s""")
def stream_request_rate(spark: SparkSession, sf: str) -> DataFrame:
    stream = audit_stream.follow_audit(spark, closed_folder(spark, sf))
    rows = append_to_table(audit_stream.request_rate(stream), "rate")
    return rows.select(F.unix_seconds("window_start").alias("start_s"), "requests")


@query("stream_recent_requests", f"""{AUDIT}, t AS (SELECT deployment, epoch(strptime(ts, '%Y-%m-%dT%H:%M:%S'))::BIGINT AS second FROM audit),
d AS (SELECT DISTINCT deployment, second FROM t)
SELECT d.deployment, d.second, count(*) AS requests FROM d JOIN t ON t.deployment = d.deployment AND t.second BETWEEN d.second - 60 AND d.second GROUP BY ALL""")
def stream_recent_requests(spark: SparkSession, sf: str) -> DataFrame:
    stream = audit_stream.follow_audit(spark, closed_folder(spark, sf))
    return append_to_table(audit_stream.recent_requests(stream), "recent").select("deployment", "second", "requests")


def table_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = tables.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


@query("stream_alert_levels", f"""{FLOOD}, a AS (SELECT least(score, 1.0) AS intensity FROM scored WHERE score >= 0.5)
SELECT c::INT AS channel, round(sum(intensity), 6) AS concentration FROM a, range(0, 4) r(c) GROUP BY ALL""")
def stream_alert_levels(spark: SparkSession, sf: str) -> DataFrame:
    alerts = signal_stream.alert_stream(table_stream(spark, sf, "documents"), threshold=0.5)
    return rounded(latest_to_table(signal_stream.channel_stream(alerts), "alerts"), "concentration")


@query("stream_channel_dissipation", f"""{EVENTS}, k AS (SELECT channel, intensity, floor(epoch(ts))::BIGINT // 86400 AS day FROM b),
m AS (SELECT max(floor(epoch(ts))::BIGINT // 86400) AS last FROM e)
SELECT channel, round(sum(intensity * pow(0.9, last + 1 - day)), 4) AS concentration FROM k, m GROUP BY channel""")
def stream_channel_dissipation(spark: SparkSession, sf: str) -> DataFrame:
    """Events as files in the order of time and, at the end, one without a channel a week later that closes every day."""
    path = scratch(spark, "signals")
    events = tables.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("at"),
        (F.col("event_id") * 7919 % 1048576).cast("int").alias("flags"),
        (F.col("value") / 100.0).alias("intensity"),
    )
    events.write.parquet(path)
    end = events.agg((F.max("at") + F.expr("INTERVAL 7 DAYS")).alias("at")).filter("at IS NOT NULL")
    end.select("at", F.lit(0).alias("flags"), F.lit(0.0).alias("intensity")).write.mode("append").parquet(path)
    stream = spark.readStream.schema("at TIMESTAMP, flags INT, intensity DOUBLE").parquet(path)
    sums = append_to_table(signal_stream.tick_sums(stream, "at", "1 day", delay="1 hour", channels=16), "ticks")
    day = F.floor(F.unix_seconds("tick_start") / 86400)
    last = F.broadcast(events.agg(F.floor(F.unix_seconds(F.max("at")) / 86400).alias("last")))  # one row
    return rounded(signal_stream.levels_after(sums.join(last), F.col("last") + 1 - day, 0.9), "concentration", places=4)


@query("stream_hash_chain", f"""{CHAIN.replace("ORDER BY seq", "ORDER BY (seq % 3 = 0), seq")},
placed AS (SELECT *, row_number() OVER (PARTITION BY deployment ORDER BY (seq % 3 = 0), seq) AS place FROM chained)
SELECT deployment, place, seq, prev_hash, hash FROM placed""")
def stream_hash_chain(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the rows arrives after all others: they continue the chains at the places at which they come."""
    path = scratch(spark, "audit-log")
    rows = audit_frame(spark, sf).rows
    first = ledger_stream.scratch(spark, "chain")
    for part in ("seq % 3 <> 0", "seq % 3 = 0"):
        log.write_audit(rows.filter(part), path, partition_by_day=False)
        ledger_stream.chain_stream(audit_stream.follow_audit(spark, path), f"{first}/rows", f"{first}/progress")
    chained = ledger_stream.stored_chain(spark, f"{first}/rows")
    return chained.select("deployment", F.col("seq").alias("place"), F.col("source_seq").alias("seq"), "prev_hash", "hash")


@query("stream_session_pruning", f"""{DECAY}, k AS (SELECT session_id, pos, cyc AS cycle,
    (sum(CASE WHEN is_cycle THEN 0 ELSE tok END) OVER (PARTITION BY session_id ORDER BY pos))::BIGINT AS inserted_tokens, is_cycle FROM c),
g AS (SELECT k.session_id, k.cycle::BIGINT AS cycle, k.inserted_tokens, coalesce(sum(d.tok) FILTER (d.purged_cycle <= k.cycle), 0)::BIGINT AS reclaimed_tokens,
  count(*) FILTER (d.purged_cycle = k.cycle) AS purged,
  count(*) FILTER (d.pos < k.pos AND (d.purged_cycle IS NULL OR d.purged_cycle > k.cycle)) AS active_blocks,
  coalesce(sum(d.tok) FILTER (d.pos < k.pos AND (d.purged_cycle IS NULL OR d.purged_cycle > k.cycle)), 0)::BIGINT AS active_tokens,
  string_agg(d.text, chr(10) ORDER BY d.pos) FILTER (d.pos < k.pos AND (d.purged_cycle IS NULL OR d.purged_cycle > k.cycle)) AS body,
  list([d.text] ORDER BY d.purged_cycle, d.pos) FILTER (d.purged_cycle <= k.cycle AND d.signal & 6 <> 0) AS xs
FROM k JOIN decayed d USING (session_id) WHERE k.is_cycle GROUP BY ALL),
st AS (SELECT *, list_reduce(coalesce(xs, []), lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a ELSE (a || x)[greatest(len(a) + 2 - 64, 1):] END, []::VARCHAR[]) AS held FROM g)
SELECT session_id, cycle, inserted_tokens, reclaimed_tokens, purged, active_blocks, active_tokens, coalesce(array_to_string(held, '|'), '') AS state,
  sha256(CASE WHEN len(held) > 0 THEN 'STATE:' || chr(10) || array_to_string(list_transform(held, lambda s: '- ' || s || chr(10)), '') ELSE '' END || coalesce(body, '')) AS context_sha256
FROM st""")
def stream_session_pruning(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "session-events")
    rows = cycle_rows(spark, sf).rows.select(
        "session_id",
        F.col("pos").alias("seq"),
        F.when(F.col("is_cycle"), "cycle").otherwise("insert").alias("kind"),
        F.col("text").alias("content"),
        "signal",
        "oxygen",
    )
    for low, high in ((0, 30), (30, 1 << 40)):
        rows.filter((F.col("seq") >= low) & (F.col("seq") < high)).repartition(4, "session_id").write.mode("append").parquet(f"{path}/part={low}")
    schema = spark.read.parquet(path).schema
    first = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/part=0*")
    second = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/part=*")
    root = scratch(spark, "pruner")
    for source in (first, second):
        pruned = session_state.prune_live_sessions(source)
        out = append_to_table(pruned, "pruner", path=f"{root}/rows", checkpoint=f"{root}/progress")
    counts = ["session_id", "cycle", "inserted_tokens", "reclaimed_tokens", "purged", "active_blocks", "active_tokens"]
    return out.select(*counts, F.array_join("state", "|").alias("state"), F.sha2("context", 256).alias("context_sha256"))


@query("protocol_repair", f"""{BLOCK_DECIDED.replace("WITH ", "WITH RECURSIVE ", 1)},
c AS (SELECT *, max(CASE WHEN has_use THEN pos END) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS call FROM u),
l AS (SELECT c.*, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS i FROM c JOIN decided d USING (session_id, unit_id) WHERE d.keep),
walk AS (SELECT DISTINCT session_id, 0::BIGINT AS i, FALSE AS started, NULL::VARCHAR AS giver_role, NULL::BIGINT AS giver, FALSE AS kept FROM l
  UNION ALL SELECT l.session_id, l.i, w.started OR k.keep, CASE WHEN k.keep THEN l.role ELSE w.giver_role END,
    CASE WHEN NOT k.keep THEN w.giver WHEN l.has_use THEN l.pos END, k.keep
  FROM walk w JOIN l ON l.session_id = w.session_id AND l.i = w.i + 1,
    LATERAL (SELECT (w.started OR l.role = 'user') AND (NOT l.has_result OR (coalesce(w.giver_role, '') = 'assistant' AND w.giver IS NOT DISTINCT FROM l.call AND l.call IS NOT NULL)) AS keep) k),
p AS (SELECT l.*, lead(has_result) OVER v AND lead(call) OVER v = pos AS answered FROM l JOIN walk USING (session_id, i) WHERE kept WINDOW v AS (PARTITION BY session_id ORDER BY i))
SELECT session_id, pos, role, has_use, has_result FROM p WHERE NOT (role = 'assistant' AND has_use AND NOT coalesce(answered, FALSE))""")
def protocol_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Pruned sessions of the block surface, every call with an id of its own, made protocol-valid again."""
    sessions = block_flags(spark, sf)
    layout = Layout(["session_id"], "pos", sessions.block_rows)
    call = F.when(F.col("has_use"), F.col("pos"))
    rows = layout.carry(layout.split(sessions.rows), last={"_before": call}, reuse=True)
    rows = layout.merge(rows.withColumn("call", layout.running_last(call, F.col("_before"), inclusive=False)))
    named = lambda pos: F.array(F.concat(F.lit("call-"), F.coalesce(pos.cast("string"), F.lit("none"))))
    none = F.array().cast("array<string>")
    ids = rows.select(
        "session_id", "pos", F.when(F.col("has_use"), named(F.col("pos"))).otherwise(none).alias("use_ids"),
        F.when(F.col("has_result"), named(F.col("call"))).otherwise(none).alias("result_ids"),
    )
    grouped, decided = units.gateway_plan(sessions.rows, sessions.config(AGENT_CONFIG.with_(quantum=4)), "blocks")
    left = units.reassemble(grouped, decided, ids).select("session_id", "pos", "role", "has_use", "has_result", "use_ids", "result_ids")
    return repair.repair(left, sessions.block_rows).select("session_id", "pos", "role", "has_use", "has_result")
