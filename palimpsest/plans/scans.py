"""Text scans, effort, secrets, probes, hardened sessions, cycle-based decay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.config import PruneConfig
from palimpsest.functions import effort as E
from palimpsest.functions import secrets as X
from palimpsest.functions import text as T
from palimpsest.operators import decay, prune, scans, units, vault
from palimpsest.plans import sqltext as S
from palimpsest.plans.pruning import AUDIT_COLUMNS, DECIDED, long_signals, rounded
from palimpsest.plans.registry import query
from palimpsest.sources import tables


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return tables.balanced(tables.table(spark, sf, "documents"))


def shingle_sql(words: str) -> str:
    pieces = f"list_transform(range(1, len({words}) - 6), lambda i: array_to_string({words}[i:i + 7], ' '))"
    return f"CASE WHEN len({words}) < 16 THEN 0.0 ELSE 1.0 - len(list_distinct({pieces})) / len({pieces}) END::DOUBLE"


FLOOD = f"""WITH t AS (
  SELECT doc_id, lang, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
scored AS (SELECT doc_id, lang, {shingle_sql('w')} AS score FROM t)"""


@query("flood_scores", f"{FLOOD} SELECT doc_id, round(score, 6) AS score, score >= 0.85 AS alert FROM scored")
def flood_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scans.flood_scores(documents(spark, sf), "doc_id"), "score")


@query("flood_summary", f"""{FLOOD}
SELECT lang, count(*) AS texts, count(*) FILTER (score >= 0.85) AS alerts, count(*) FILTER (score > 0) AS repetitive,
  round(max(score), 6) AS top_score, round(avg(score), 6) AS mean_score FROM scored GROUP BY lang""")
def flood_summary(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    scored = docs.select("lang", T.repetition_score(F.col("text")).alias("score"))
    flagged = scored.withColumn("alert", F.col("score") >= scans.ALERT_THRESHOLD)
    return rounded(scans.flood_summary(flagged, ["lang"]), "top_score", "mean_score")


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in dict.fromkeys(words)) + ")"


STEMS_SQL = " OR ".join(f"starts_with(x, '{s}')" for s in dict.fromkeys(E.HARD_STEMS))


def effort_sql(source: str) -> str:
    return f"""WITH src AS ({source}),
l AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w, lower(text) AS lo FROM src),
m AS (SELECT *, list_transform(w, lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')) AS tw FROM l),
c AS (SELECT *, len(w) AS n,
    len(list_filter(tw, lambda x: x IN {in_list(E.HARD_WORDS)} OR {STEMS_SQL})) AS hard,
    len(list_filter(tw, lambda x: x IN {in_list(E.CONSTRAINT_WORDS)})) AS cons,
    len(list_filter(tw, lambda x: x IN {in_list(E.TRIVIAL_WORDS)})) AS triv,
    len(list_filter(tw, lambda x: x IN {in_list(E.CODE_WORDS)}))
      + (length(lo) - length(translate(lo, '{E.CODE_CHARS}', ''))) // 6 AS code,
    (length(lo) - length(translate(lo, '0123456789', '')))::FLOAT AS digits, strlen(lo)::FLOAT AS nbytes,
    CASE WHEN len(w) > 0 THEN len(list_distinct(w))::FLOAT / len(w)::FLOAT ELSE 0::FLOAT END AS novelty FROM m),
r AS (SELECT *, 0.30::FLOAT * least(n::FLOAT / 400::FLOAT, 1::FLOAT) + 0.25::FLOAT * least(hard::FLOAT / 3::FLOAT, 1::FLOAT)
    + 0.20::FLOAT * least(cons::FLOAT / 6::FLOAT, 1::FLOAT) + 0.15::FLOAT * least(code::FLOAT / 12::FLOAT, 1::FLOAT)
    + 0.10::FLOAT * least(CASE WHEN nbytes > 0 THEN digits / nbytes ELSE 0::FLOAT END * 8::FLOAT, 1::FLOAT) AS raw FROM c),
q AS (SELECT *, greatest(least(raw * (0.5::FLOAT + 0.5::FLOAT * novelty), 1::FLOAT), 0::FLOAT) AS s0 FROM r),
z AS (SELECT *, CASE WHEN (n < 8 AND hard = 0 AND code = 0) OR (n <= 3 AND triv > 0) THEN least(s0, 0.05::FLOAT) ELSE s0 END AS s FROM q),
scored AS (SELECT *, CASE WHEN s < 0.15::FLOAT THEN CASE WHEN hard >= 1 AND n >= 4 AND s > 0.05::FLOAT THEN 'low' ELSE 'off' END
    WHEN s < 0.40::FLOAT THEN 'low' WHEN s < 0.70::FLOAT THEN 'medium' ELSE 'high' END AS tier FROM z),
budgeted AS (SELECT *, CASE tier WHEN 'off' THEN 0 WHEN 'low' THEN 1024 WHEN 'medium' THEN 4096 ELSE 16384 END AS budget FROM scored)"""


@query("effort_scores", f"""{effort_sql("SELECT doc_id AS id, text FROM documents")}
SELECT id, n AS words, hard AS hard_hits, cons AS constraint_hits, code::BIGINT AS code_hits, triv AS trivial_hits,
  round(s::DOUBLE, 5) AS score, tier, budget::BIGINT AS budget_tokens FROM budgeted""")
def effort_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = scans.effort(documents(spark, sf).select(F.col("doc_id").alias("id"), "text"))
    return scored.select(
        "id",
        "signals.words",
        "signals.hard_hits",
        "signals.constraint_hits",
        "signals.code_hits",
        "signals.trivial_hits",
        F.round(F.col("score").cast("double"), 5).alias("score"),
        "tier",
        "budget_tokens",
    )


EFFORT_SOURCES = """SELECT 'page' AS kind, html AS text FROM pages UNION ALL SELECT 'document', text FROM documents
UNION ALL SELECT 'turn', text FROM conversations WHERE role = 'user'"""


@query("effort_mix", f"""{effort_sql(EFFORT_SOURCES)}
SELECT kind, tier, count(*) AS turns, sum(budget)::BIGINT AS budget_tokens FROM budgeted GROUP BY ALL""")
def effort_mix(spark: SparkSession, sf: str) -> DataFrame:
    pages = tables.balanced(tables.table(spark, sf, "pages")).select(F.lit("page").alias("kind"), F.col("html").alias("text"))
    docs = documents(spark, sf).select(F.lit("document").alias("kind"), "text")
    turns = tables.balanced(tables.table(spark, sf, "conversations")).filter("role = 'user'").select(F.lit("turn").alias("kind"), "text")
    return scans.effort_mix(scans.effort(pages.unionByName(docs).unionByName(turns)), ["kind"])


REQUEST_SQL = """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'chat' ELSE 'blocks' END AS surface,
  CASE WHEN doc_id % 29 = 0 THEN '' ELSE text END AS text, doc_id % 6 = 0 AS has_reasoning,
  CASE WHEN doc_id % 3 = 1 THEN 'enabled' END AS thinking_type, CASE WHEN doc_id % 3 = 1 THEN 512 + doc_id % 5000 END AS thinking_budget,
  CASE WHEN doc_id % 7 = 0 THEN 0.5 WHEN doc_id % 7 = 1 THEN 1.0 END::DOUBLE AS temperature, 1000 + doc_id % 9000 AS max_tokens
  FROM documents"""


def request_frame(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    return documents(spark, sf).select(
        i.alias("id"),
        F.when(i % 2 == 0, "chat").otherwise("blocks").alias("surface"),
        F.when(i % 29 == 0, "").otherwise(F.col("text")).alias("text"),
        (i % 6 == 0).alias("has_reasoning"),
        F.when(i % 3 == 1, "enabled").alias("thinking_type"),
        F.when(i % 3 == 1, 512 + i % 5000).alias("thinking_budget"),
        F.when(i % 7 == 0, 0.5).when(i % 7 == 1, 1.0).alias("temperature"),
        (1000 + i % 9000).alias("max_tokens"),
    )


@query("effort_policy", f"""{effort_sql(REQUEST_SQL)}, a AS (SELECT *,
  CASE WHEN surface = 'chat' THEN CASE WHEN has_reasoning THEN 'client_set' WHEN tier = 'off' THEN 'disabled' ELSE 'effort=' || tier END
       WHEN thinking_type = 'enabled' THEN CASE WHEN tier = 'off' AND thinking_budget > 1024 THEN 'downgraded ' || thinking_budget || '->1024'
            ELSE 'client_set' END
       WHEN thinking_type IS NULL AND tier IN ('medium', 'high') AND (temperature IS NULL OR temperature = 1)
            AND max_tokens > budget + 256 THEN 'added ' || budget ELSE 'none' END AS act FROM budgeted)
SELECT id, surface, CASE WHEN text <> '' THEN tier END AS tier, CASE WHEN text <> '' THEN round(s::DOUBLE, 3) END AS score,
  CASE WHEN text <> '' THEN act END AS action,
  CASE WHEN text <> '' AND starts_with(act, 'downgraded') THEN 1024 WHEN text <> '' AND starts_with(act, 'added') THEN budget
       ELSE thinking_budget END::BIGINT AS new_budget FROM a""")
def effort_policy(spark: SparkSession, sf: str) -> DataFrame:
    return scans.effort_policy(request_frame(spark, sf)).select("id", "surface", "tier", "score", "action", "new_budget")


@query("consolidation_gain", f"""{DECIDED}, a AS (SELECT session_id, {AUDIT_COLUMNS} FROM decided GROUP BY session_id),
p AS (SELECT session_id, tokens_before AS p, CASE WHEN session_id = 3 THEN 0 ELSE tokens_before - tokens_after END AS x, session_id AS k0,
  greatest(session_id, 1)::DOUBLE AS k FROM a),
n AS (SELECT *, (p - least(x, p))::DOUBLE AS nw FROM p)
SELECT session_id, round(k * p * 0.1, 6) AS cost_keep, round(nw * 1.25 + (k - 1) * nw * 0.1, 6) AS cost_consolidate,
  round(k * p * 0.1 - (nw * 1.25 + (k - 1) * nw * 0.1), 6) AS gain,
  CASE WHEN x = 0 THEN 'infinity'::DOUBLE ELSE round(nw * 1.15 / (0.1 * (p - nw)), 6) END AS break_even_calls,
  k * p * 0.1 - (nw * 1.25 + (k - 1) * nw * 0.1) > 0 AS consolidate FROM n""")
def consolidation_gain(spark: SparkSession, sf: str) -> DataFrame:
    audit = prune.session_audit(prune.decide(long_signals(spark, sf).rows, PruneConfig()))
    gone = F.col("tokens_before") - F.col("tokens_after")
    sessions = audit.select(
        "session_id",
        F.col("tokens_before").alias("prefix_tokens"),
        F.when(F.col("session_id") == 3, 0).otherwise(gone).alias("purgeable_tokens"),
        F.col("session_id").alias("calls_ahead"),
    )
    out = rounded(scans.consolidation(sessions), "cost_keep", "cost_consolidate", "gain")
    even = F.col("break_even_calls")
    out = out.withColumn("break_even_calls", F.when(even == float("inf"), even).otherwise(F.round(even, 6)))
    return out.drop("prefix_tokens", "purgeable_tokens", "calls_ahead")


# Words of the data that play the declared secrets.
VAULT = ["reti", "tion", "and the", "éonç", ".\nT"]
VAULT_SQL = "[" + ", ".join(f"'{v}'" for v in VAULT) + "]"


@query("vault_exposure", f"""WITH v AS (SELECT unnest(range(1, {len(VAULT) + 1})) AS i),
n AS (SELECT i AS vault_entry, {VAULT_SQL}[i] AS s FROM v)
SELECT doc_id, vault_entry FROM documents JOIN n ON contains(text, s)""")
def vault_exposure(spark: SparkSession, sf: str) -> DataFrame:
    return scans.vault_exposure(documents(spark, sf), "doc_id", VAULT)


@query("vault_table_exposure", """WITH v AS (SELECT DISTINCT substring(text, (1 + doc_id % 40)::BIGINT, (6 + doc_id % 30)::BIGINT) AS secret FROM documents)
SELECT doc_id, count(*) AS secrets, min(secret) AS first_secret FROM documents JOIN v ON secret <> '' AND contains(text, secret) GROUP BY doc_id""")
def vault_table_exposure(spark: SparkSession, sf: str) -> DataFrame:
    """A vault with an entry from every document, looked for in all documents."""
    docs = tables.table(spark, sf, "documents")
    entry = F.substring(F.col("text"), F.lit(1) + (F.col("doc_id") % 40).cast("int"), F.lit(6) + (F.col("doc_id") % 30).cast("int"))
    return vault.exposure_totals(docs.select("doc_id", "text"), docs.select(entry.alias("secret")), id_col="doc_id")


def redact_sql(text: str) -> tuple[str, str, str]:
    current, hits = text, []
    for v in VAULT:
        hits.append(f"(length({current}) - length(replace({current}, '{v}', ''))) // {len(v)}")
        current = f"replace({current}, '{v}', '[REDACTED]')"
    clean = "NOT (" + " OR ".join(f"contains({current}, '{v}')" for v in VAULT) + ")"
    return current, " + ".join(hits), clean


REDACTED, HITS, CLEAN = redact_sql("text")


@query("vault_redaction", f"""SELECT conv_id, turn, {REDACTED} AS text, ({HITS})::BIGINT AS hits, {CLEAN} AS clean FROM conversations""")
def vault_redaction(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return scans.redacted(rows, VAULT)


# Patterns a caller adds after the built-in ones; these occur in the given documents.
CALLER_PATTERNS = [
    *X.SECRET_PATTERNS,
    ("hex_token", r'token = "[0-9a-f]{40}"'),
    ("mail", r"[0-9]+@mail[0-9]*[.]example[.]com"),
]
KIND_SQL = "CASE WHEN contains(line, 'reti and') THEN 'vault' " + " ".join(
    f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in CALLER_PATTERNS
) + " END"
FINDINGS = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
k AS (SELECT doc_id, line_no, {KIND_SQL} AS kind FROM l)"""


@query("secret_findings", f"{FINDINGS} SELECT doc_id, line_no::BIGINT AS line_no, kind FROM k WHERE kind IS NOT NULL")
def secret_findings(spark: SparkSession, sf: str) -> DataFrame:
    found = scans.secret_findings(documents(spark, sf), "doc_id", ["reti and"], CALLER_PATTERNS)
    return found.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "kind")


@query("secret_findings_by_kind", f"""{FINDINGS}
SELECT kind, count(*) AS findings, count(DISTINCT doc_id) AS texts FROM k WHERE kind IS NOT NULL GROUP BY kind""")
def secret_findings_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    found = scans.secret_findings(documents(spark, sf), "doc_id", ["reti and"], CALLER_PATTERNS)
    per_text = found.groupBy("kind", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per_text.groupBy("kind").agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("texts"))


@query("redaction_hits_by_session", f"""SELECT conv_id AS session_id, sum({HITS})::BIGINT AS secrets_redacted,
  bool_and({CLEAN}) AS outbound_clean FROM conversations GROUP BY conv_id""")
def redaction_hits_by_session(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "conversations").select(F.col("conv_id").alias("session_id"), "text")
    return scans.redacted(rows, VAULT).groupBy("session_id").agg(
        F.sum("hits").alias("secrets_redacted"), F.bool_and("clean").alias("outbound_clean")
    )


PROBES = {"en": ["The on", "tion", "erthat", "and"], "fr": ["leau", "QUE", "ç en"], "de": ["ung", "der"], "es": ["ción", "que"]}
PROBE_SQL = "CASE lang " + " ".join(
    f"WHEN '{k}' THEN round((" + " + ".join(f"contains(lower(text), '{p.lower()}')::INT" for p in v) + f") / {len(v)}.0, 6)"
    for k, v in PROBES.items()
) + " END::DOUBLE"


@query("probe_coverage", f"SELECT doc_id, {PROBE_SQL} AS coverage FROM documents")
def probe_coverage(spark: SparkSession, sf: str) -> DataFrame:
    out = scans.probe_coverage(documents(spark, sf), F.col("lang"), PROBES)
    return rounded(out.select("doc_id", "coverage"), "coverage")


@query("contract_checks", """SELECT doc_id, contains(text, 'The') AS names_the, contains(text, 'on') AND contains(text, 'er') AS both_parts
FROM documents""")
def contract_checks(spark: SparkSession, sf: str) -> DataFrame:
    out = scans.contract_checks(documents(spark, sf), {"names_the": ["The"], "both_parts": ["on", "er"]})
    return out.select("doc_id", "names_the", "both_parts")


@query("keyword_gate", """WITH k AS (SELECT *, CASE WHEN lang = 'en' THEN ['The', 'ing'] ELSE ['e', 'La'] END AS kws FROM documents)
SELECT doc_id, contains(text, kws[1]) AND contains(text, kws[2]) AS success,
  contains(text, kws[1])::INT + contains(text, kws[2])::INT AS hits FROM k""")
def keyword_gate(spark: SparkSession, sf: str) -> DataFrame:
    words = F.when(F.col("lang") == "en", F.array(F.lit("The"), F.lit("ing"))).otherwise(F.array(F.lit("e"), F.lit("La")))
    gated = scans.keyword_gate(documents(spark, sf), words)
    return gated.select("doc_id", "success", F.size(F.filter("keyword_hits", lambda h: h)).alias("hits"))


@query("one_line_digests", """WITH w AS (SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), ' ') AS flat
  FROM documents), b AS (SELECT *, encode(flat) AS raw, strlen(flat) AS n FROM w),
c AS (SELECT *, 120 + CASE WHEN n <= 120 THEN 0 WHEN length(flat) = n THEN 0 ELSE
    (SELECT count(*) FROM range(120, 123) r(i) WHERE i < n AND hex(raw[i + 1:i + 1]) BETWEEN '80' AND 'BF'
      AND (i = 120 OR hex(raw[121:121]) BETWEEN '80' AND 'BF') AND (i < 122 OR hex(raw[122:122]) BETWEEN '80' AND 'BF')) END AS cut FROM b)
SELECT doc_id, CASE WHEN n <= cut THEN flat ELSE decode(raw[1:cut]) || '…' END AS digest FROM c""")
def one_line_digests(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", T.one_line_digest(F.col("text")).alias("digest"))


def hardened_input(spark: SparkSession, sf: str) -> tuple[DataFrame, PruneConfig]:
    """Long sessions up to their last user turn, which is the query; the first turn is the system text."""
    sessions = long_signals(spark, sf)
    rows = units.split_at_query(sessions.rows, sessions.config()).filter(F.col("pos") <= F.col("split"))
    zone = F.when(F.col("pos") == F.col("split"), "query").when(F.col("pos") == 0, "system").otherwise("history")
    return rows.withColumns({"zone": zone, "n": F.col("split")}), sessions.config()


# What leaves with each session, put together before it is masked.
OUTBOUND = f"""z AS (
  SELECT session_id, string_agg(text, chr(10) ORDER BY pos) FILTER (pos > 0 AND pos < q AND keep) AS context, max(text) FILTER (pos = q) AS request,
    max(text) FILTER (pos = 0 AND q > 0) AS system FROM r GROUP BY session_id),
o AS (SELECT session_id, sum({HITS})::BIGINT AS secrets_redacted, bool_and({CLEAN}) AS outbound_clean
  FROM (SELECT session_id, unnest([context, request, system]) AS text FROM z) WHERE text IS NOT NULL GROUP BY session_id)"""


@query("hardened_report", f"""WITH {S.LONG}, q AS (
  SELECT *, max(CASE WHEN role = 'user' THEN pos END) OVER (PARTITION BY session_id) AS q, {S.TOKENS} AS tok, {S.ROLE_SIGNAL} AS signal FROM long),
r AS (SELECT *, pos = q OR {S.alive('signal', 'q - 1 - pos')} AS keep FROM q WHERE pos <= q),
w AS (SELECT session_id, list_filter(regexp_split_to_array(string_agg(text, chr(10) ORDER BY pos), '\\s+'), lambda x: x <> '') AS w
      FROM r WHERE pos > 0 OR pos = q GROUP BY session_id),
f AS (SELECT session_id, {shingle_sql('w')} AS score FROM w),
a AS (SELECT session_id, sum(tok) FILTER (pos > 0 AND pos < q)::BIGINT AS tokens_before,
  coalesce(sum(tok) FILTER (pos > 0 AND pos < q AND keep), 0)::BIGINT AS tokens_after FROM r GROUP BY session_id),
{OUTBOUND}
SELECT session_id, round(score, 4) AS saturation, score >= 0.85 AS red_alert, secrets_redacted, outbound_clean, tokens_before, tokens_after,
  round(1.0 - tokens_after / tokens_before, 6) AS reduction FROM f JOIN a USING (session_id) JOIN o USING (session_id)""")
def hardened_report(spark: SparkSession, sf: str) -> DataFrame:
    rows, cfg = hardened_input(spark, sf)
    return rounded(scans.hardened_report(rows, cfg, VAULT), "reduction")


MASKED = {name: redact_sql(name)[0] for name in ("context", "request", "system")}


@query("hardened_prompts", f"""WITH {S.LONG}, q AS (
  SELECT *, max(CASE WHEN role = 'user' THEN pos END) OVER (PARTITION BY session_id) AS q, {S.ROLE_SIGNAL} AS signal FROM long),
r AS (SELECT *, {S.alive('signal', 'q - 1 - pos')} AS keep FROM q WHERE pos <= q),
{OUTBOUND}
SELECT session_id, 0::BIGINT AS part, 'Context:' || chr(10) || {MASKED['context']} || chr(10) || chr(10) || 'Request:' || chr(10)
  || {MASKED['request']} AS prompt, {MASKED['system']} AS system FROM z""")
def hardened_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows, cfg = hardened_input(spark, sf)
    return scans.hardened_prompts(rows, cfg, VAULT)


@query("hardened_responses", f"""WITH {S.LONG}, q AS (
  SELECT *, max(CASE WHEN role = 'user' THEN pos END) OVER (PARTITION BY session_id) AS q, {S.ROLE_SIGNAL} AS signal FROM long),
r AS (SELECT *, pos = q OR {S.alive('signal', 'q - 1 - pos')} AS keep FROM q WHERE pos <= q),
{OUTBOUND},
x AS (SELECT session_id, arg_max(text, pos) AS text FROM q WHERE role = 'assistant' GROUP BY session_id)
SELECT session_id, {REDACTED} AS text, (secrets_redacted + {HITS})::BIGINT AS secrets_redacted, outbound_clean AND {CLEAN} AS outbound_clean
FROM x JOIN o USING (session_id)""")
def hardened_responses(spark: SparkSession, sf: str) -> DataFrame:
    rows, cfg = hardened_input(spark, sf)
    report = scans.hardened_report(rows, cfg, VAULT)
    answers = long_signals(spark, sf).rows.filter("role = 'assistant'").groupBy("session_id").agg(
        F.max_by("text", "pos").alias("text")
    )
    return scans.hardened_responses(answers, report, VAULT)


def cycle_rows(spark: SparkSession, sf: str) -> tables.Sessions:
    """Event sessions in which every purchase ends a turn and runs one decay cycle."""
    sessions = tables.event_sessions(spark, sf)
    return sessions.with_rows(
        sessions.rows.select(
            "session_id",
            "pos",
            (F.col("event_type") == "purchase").alias("is_cycle"),
            "signal",
            "text",
            F.when(F.col("event_id") % 10 == 0, 3.0).alias("oxygen"),
        )
    )


DECAY = f"""WITH {S.EVENTS}, c AS (
  SELECT session_id, pos, event_type = 'purchase' AS is_cycle, signal, text, {S.TOKENS} AS tok,
    sum((event_type = 'purchase')::INT) OVER (PARTITION BY session_id ORDER BY pos) AS cyc,
    sum((event_type = 'purchase')::INT) OVER (PARTITION BY session_id) AS total,
    CASE WHEN event_id % 10 = 0 THEN 3.0 ELSE {S.weight('signal')} END::DOUBLE AS o0 FROM ev),
d AS (SELECT *, (total - cyc)::BIGINT AS cycles, cyc + CASE WHEN signal & 9 = 0 THEN
    list_min(list_filter(range(1, 80), lambda k: o0 * pow(2.0, -k / 2.0) < 0.35)) END AS gone_at FROM c WHERE NOT is_cycle),
decayed AS (SELECT *, CASE WHEN gone_at <= total THEN gone_at END::BIGINT AS purged_cycle FROM d)"""


@query("cycle_decay", f"""{DECAY}
SELECT session_id, pos, cycles, round(CASE WHEN signal & 9 <> 0 THEN o0 + 0.5 * cycles ELSE o0 * pow(2.0, -cycles / 2.0) END, 6) AS level,
  purged_cycle, purged_cycle IS NULL AS alive FROM decayed""")
def cycle_decay(spark: SparkSession, sf: str) -> DataFrame:
    sessions = cycle_rows(spark, sf)
    out = decay.decay_cycles(sessions.rows, block_rows=sessions.block_rows)
    return rounded(out.select("session_id", "pos", "cycles", "level", "purged_cycle", "alive"), "level")


@query("reclaimed_ratio", f"""{DECAY}, k AS (SELECT session_id, pos, cyc AS cycle,
    (sum(CASE WHEN is_cycle THEN 0 ELSE tok END) OVER (PARTITION BY session_id ORDER BY pos))::BIGINT AS inserted_tokens, is_cycle FROM c),
g AS (SELECT k.session_id, k.cycle, k.inserted_tokens,
    coalesce(sum(d.tok), 0)::BIGINT AS reclaimed_tokens FROM k LEFT JOIN decayed d ON d.session_id = k.session_id AND d.purged_cycle <= k.cycle
  WHERE k.is_cycle GROUP BY ALL)
SELECT session_id, cycle::BIGINT AS cycle, inserted_tokens, reclaimed_tokens,
  round(CASE WHEN inserted_tokens > 0 THEN reclaimed_tokens / inserted_tokens ELSE 0 END, 6) AS ratio FROM g""")
def reclaimed_ratio(spark: SparkSession, sf: str) -> DataFrame:
    sessions = cycle_rows(spark, sf)
    decayed = decay.decay_cycles(sessions.rows, block_rows=sessions.block_rows)
    return rounded(decay.reclaimed_ratio(sessions.rows, decayed, block_rows=sessions.block_rows), "ratio")


def state_sql(capacity: int) -> str:
    return f"""{DECAY}, facts AS (SELECT session_id, list([text] ORDER BY purged_cycle, pos) AS xs FROM decayed
  WHERE purged_cycle IS NOT NULL AND signal & 6 <> 0 GROUP BY session_id)
SELECT session_id, array_to_string(list_reduce(xs, lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a
  ELSE (a || x)[greatest(len(a) + 2 - {capacity}, 1):] END, []::VARCHAR[]), '|') AS state FROM facts"""


def state_rows(spark: SparkSession, sf: str, capacity: int) -> DataFrame:
    sessions = cycle_rows(spark, sf)
    decayed = decay.decay_cycles(sessions.rows, block_rows=sessions.block_rows)
    facts = decay.absorbed_digests(decayed, sessions.block_rows)
    held = decay.state_list(facts, capacity, sessions.block_rows)
    return held.select("session_id", F.array_join("state", "|").alias("state"))


@query("state_list", state_sql(decay.STATE_CAPACITY))
def state_list(spark: SparkSession, sf: str) -> DataFrame:
    return state_rows(spark, sf, decay.STATE_CAPACITY)


@query("state_list_evicting", state_sql(4))
def state_list_evicting(spark: SparkSession, sf: str) -> DataFrame:
    return state_rows(spark, sf, 4)


@query("state_rendering", f"""{DECAY}, facts AS (SELECT session_id, list([text] ORDER BY purged_cycle, pos) AS xs FROM decayed
  WHERE purged_cycle IS NOT NULL AND signal & 6 <> 0 GROUP BY session_id),
st AS (SELECT session_id, list_reduce(xs, lambda a, x: CASE WHEN list_contains(a, x[1]) THEN a
  ELSE (a || x)[greatest(len(a) + 2 - 4, 1):] END, []::VARCHAR[]) AS state FROM facts),
ctx AS (SELECT session_id, string_agg(text, chr(10) ORDER BY pos) AS context FROM decayed WHERE purged_cycle IS NULL GROUP BY session_id)
SELECT session_id, 0::BIGINT AS part, 'Purpose: keep orders' || chr(10) || CASE WHEN len(state) > 0 THEN 'STATE:' || chr(10)
  || array_to_string(list_transform(state, lambda s: '- ' || s || chr(10)), '') ELSE '' END || coalesce(context, '') AS prompt
FROM (SELECT DISTINCT session_id FROM decayed) LEFT JOIN ctx USING (session_id) LEFT JOIN st USING (session_id)""")
def state_rendering(spark: SparkSession, sf: str) -> DataFrame:
    sessions = cycle_rows(spark, sf)
    decayed = decay.decay_cycles(sessions.rows, block_rows=sessions.block_rows)
    held = decay.state_list(decay.absorbed_digests(decayed, sessions.block_rows), 4, sessions.block_rows)
    parts = prune.render(decayed.filter("alive"))
    return decay.render_sessions("Purpose: keep orders", decayed.select("session_id"), held, parts)
