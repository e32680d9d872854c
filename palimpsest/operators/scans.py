"""Scans over text columns and sessions: floods, effort, secrets, probes, economics."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import BLOCK_ROWS, PruneConfig
from palimpsest.functions import effort as E
from palimpsest.functions import secrets as X
from palimpsest.functions import text as T
from palimpsest.operators import prune
from palimpsest.operators.lineage import cut
from palimpsest.operators.sequence import BLOCK, Layout, number_rows

# Flood alert threshold, event flags of an alert, and the default economics.
ALERT_THRESHOLD = 0.85
ALERT_FLAGS = 0x0F
CACHE_READ_RATIO = 0.1
CACHE_WRITE_RATIO = 1.25
CALLS_AHEAD = 8

# The flood score takes this many positions of a session together, and about this many bytes of text per task.
FLOOD_ROWS = 1024
FLOOD_BYTES = 4 << 20


def flood_scores(texts: DataFrame, id_col: str, *, window: int = 8, threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """Repetition score and alert flag per text; computed inside each row, without a shuffle."""
    scored = texts.select(id_col, T.repetition_score(F.col("text"), window).alias("score"))
    return scored.withColumn("alert", F.col("score") >= threshold)


def flood_summary(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scores.groupBy(*by).agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if("alert").alias("alerts"),
        F.count_if(F.col("score") > 0).alias("repetitive"),
        F.max("score").alias("top_score"),
        F.avg("score").alias("mean_score"),
    )


def alert_events(scores: DataFrame) -> DataFrame:
    """Signal events of the texts that raise an alert."""
    return scores.filter("alert").withColumns(
        {"flags": F.lit(ALERT_FLAGS), "intensity": F.least(F.col("score"), F.lit(1.0))}
    )


def session_flood(messages: DataFrame, keys: Sequence[str], *, window: int = 8, block_rows: int = 0) -> DataFrame:
    """Repetition score of whole sessions: shingles run across message borders.

    Each message owns the shingles that start in it; the tokens it lacks come from at most window - 1
    later messages with text. Shingles travel as 64-bit hashes and are counted in two steps, first per
    (session, hash), so repeated shingles of a hot session combine before the shuffle.

    A session is always cut into blocks, and the blocks are dealt to as many tasks as the texts need: a task explodes the
    shingles of about FLOOD_BYTES of text, however long the sessions are. A block gets the words that follow it by a carried value.
    """
    layout = Layout(keys, "pos", min(block_rows or FLOOD_ROWS, FLOOD_ROWS))
    short = window - 1
    # Blank rows hold no tokens; without them the lookahead spans a bounded number of rows.
    rows = layout.split(messages.select(*keys, "pos", "text").filter(F.col("text").rlike(T.NOT_BLANK)))
    rows = rows.withColumn("_head", T.first_words(F.col("text"), short))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.repartition(math.ceil(size / FLOOD_BYTES) or 1, *layout.cells)
    w = layout.window()
    joined = lambda heads: F.slice(F.flatten(heads), 1, short)
    in_block = F.collect_list("_head").over(w.rowsBetween(1, max(short, 1)))
    # Every row has a word, so the first rows of a block hold the words that the block before it lacks.
    opening = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "_head"))), 1, max(short, 1)), lambda r: r["_head"])
    following = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(1, max(short, 1))
    blocks = rows.groupBy(*layout.cells).agg(joined(opening).alias("_open")).select(
        *layout.cells, joined(F.collect_list("_open").over(following)).alias("_next")
    )
    own = dealt.withColumn("_in", in_block).join(blocks, layout.cells).select(
        *keys, T.words(F.col("text")).alias("_w"), joined(F.array(F.flatten("_in"), F.col("_next"))).alias("_ahead")
    )
    hashes = own.select(*keys, F.size("_w").alias("_n"), T.shingle_hashes(F.concat("_w", "_ahead"), window).alias("_hashes"))
    shingles = hashes.select(*keys, "_n", F.posexplode_outer("_hashes").alias("_i", "_h"))
    counts = (
        shingles.groupBy(*keys, "_h")
        .agg(F.sum(F.when(F.coalesce("_i", F.lit(0)) == 0, F.col("_n")).otherwise(0)).alias("_n"), F.count("_h").alias("_c"))
        .groupBy(*keys)
        .agg(F.sum("_n").alias("tokens"), F.sum("_c").alias("_total"), F.count("_h").alias("_distinct"))
    )
    score = F.when(
        (F.col("tokens") >= 2 * window) & (F.col("_total") > 0), 1.0 - F.col("_distinct") / F.col("_total")
    ).otherwise(0.0)
    return counts.select(*keys, "tokens", score.alias("score"))


def effort(texts: DataFrame) -> DataFrame:
    """signals, score, tier and budget of the column `text`."""
    scored = texts.withColumn("_effort", E.effort_of(F.col("text")))
    return scored.select(*texts.columns, "_effort.*")


def effort_mix(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*by, "tier").agg(
        F.count(F.lit(1)).alias("turns"), F.sum("budget_tokens").alias("budget_tokens")
    )


def effort_policy(requests: DataFrame) -> DataFrame:
    """Effort decision per request. `text` is the last user text; without one the policy is inactive.

    Input: surface ("chat" or "blocks"), text, has_reasoning, thinking_type, thinking_budget,
    temperature, max_tokens.
    """
    scored = effort(requests)
    action = E.policy_action(
        F.col("surface"),
        F.col("tier"),
        F.col("has_reasoning"),
        F.col("thinking_type"),
        F.col("thinking_budget"),
        F.col("temperature"),
        F.col("max_tokens"),
    )
    active = F.coalesce(F.col("text"), F.lit("")) != ""
    decided = scored.withColumn("action", F.when(active, action))
    lowered = F.col("action").startswith("downgraded")
    added = F.col("action").startswith("added")
    return decided.withColumns(
        {
            "tier": F.when(active, F.col("tier")),
            "score": F.when(active, F.bround(F.col("score").cast("double"), 3)),
            "new_budget": F.when(lowered, F.lit(E.MIN_BUDGET).cast("bigint"))
            .when(added, F.col("budget_tokens"))
            .otherwise(F.col("thinking_budget").cast("bigint")),
        }
    ).drop("signals", "budget_tokens")


def consolidation(sessions: DataFrame, *, read_ratio: float = CACHE_READ_RATIO, write_ratio: float = CACHE_WRITE_RATIO) -> DataFrame:
    """Is rewriting a cached prefix worth it? Input: prefix_tokens, purgeable_tokens, calls_ahead."""
    prefix = F.col("prefix_tokens").cast("double")
    purgeable = F.least(F.col("purgeable_tokens"), F.col("prefix_tokens"))
    left = (F.col("prefix_tokens") - purgeable).cast("double")
    calls = F.greatest(F.col("calls_ahead"), F.lit(1)).cast("double")
    keep = calls * prefix * read_ratio
    rewrite = left * write_ratio + (calls - 1.0) * left * read_ratio
    even = F.when(purgeable == 0, F.lit(float("inf"))).otherwise(
        F.try_divide(left * (write_ratio - read_ratio), read_ratio * (prefix - left))
    )
    return sessions.withColumns(
        {"cost_keep": keep, "cost_consolidate": rewrite, "gain": keep - rewrite, "break_even_calls": even}
    ).withColumn("consolidate", F.col("gain") > 0)


def vault_exposure(texts: DataFrame, id_col: str, vault: Sequence[str]) -> DataFrame:
    """One row per (text, vault entry it contains); entries appear as positions."""
    return texts.select(id_col, F.explode(X.contained(F.col("text"), vault)).alias("vault_entry"))


def redacted(texts: DataFrame, vault: Sequence[str]) -> DataFrame:
    """`text` masked, with the number of hits and whether anything is left."""
    done = texts.withColumn("_r", X.redact(F.col("text"), vault))
    return done.withColumns({"text": F.col("_r.text"), "hits": F.col("_r.hits")}).withColumn(
        "clean", ~X.leaks(F.col("text"), vault)
    ).drop("_r")


def secret_findings(texts: DataFrame, id_col: str, vault: Sequence[str] = (),
                    patterns: Sequence[tuple[str, str]] = X.SECRET_PATTERNS) -> DataFrame:
    """Lines that hold a secret, with its kind."""
    lines = texts.select(id_col, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.withColumn("kind", X.secret_kind(F.col("line"), vault, patterns)).filter(F.col("kind").isNotNull())


def probe_coverage(texts: DataFrame, scenario: Column, probes: Mapping[str, Sequence[str]]) -> DataFrame:
    """Share of the probes of each row's scenario that its text contains, ignoring case."""
    lowered = F.lower(F.coalesce(F.col("text"), F.lit("")))
    coverage = F.lit(None).cast("double")
    for name, words in probes.items():
        needles = F.array(*[F.lit(w.lower()) for w in words])
        share = F.size(F.filter(needles, lambda p: F.contains(lowered, p))) / len(words)
        coverage = F.when(scenario == name, share).otherwise(coverage)
    return texts.withColumn("coverage", coverage)


def contract_checks(texts: DataFrame, checks: Mapping[str, Sequence[str]]) -> DataFrame:
    """One boolean per contract: all its strings occur in the text, case included."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    columns = {
        name: F.forall(F.array(*[F.lit(w) for w in words]), lambda p: F.contains(whole, p))
        for name, words in checks.items()
    }
    return texts.withColumns(columns)


def keyword_gate(texts: DataFrame, keywords: Column) -> DataFrame:
    """success: every keyword of the array column occurs; hits: one flag per keyword, in order."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    return texts.withColumn("keyword_hits", F.transform(keywords, lambda k: F.contains(whole, k))).withColumn(
        "success", F.forall("keyword_hits", lambda h: h)
    )


def _meets_mask(secret: str) -> bool:
    """Can a match of this value hold characters of a mask that an earlier value left?"""
    m = X.MASK
    return m in secret or any(secret.startswith(m[i:]) or secret.endswith(m[: i + 1]) for i in range(len(m)))


def tied_rows(rows: DataFrame, secrets: Sequence[str], keys: Sequence[str], block_rows: int = 0) -> DataFrame:
    """`rows` with neighbours put together, by line breaks, where one of the values runs over the border between them.

    A value can only do so with its own line breaks: at each of them, what is before it ends the texts up to the border and what
    is behind it begins the texts from there. Only the ends of texts are compared, over as many rows as the value has lines.
    """
    cuts = [(s[:i], s[i + 1 :]) for s in secrets for i, c in enumerate(s) if c == "\n"]
    if not cuts:
        return rows
    near = max(s.count("\n") for s in secrets)
    longest = max(len(s) for s in secrets)
    ends = rows.select(*keys, "pos", F.substring("text", 1, longest).alias("_head"), F.substring("text", -longest, longest).alias("_tail"))
    layout = Layout(keys, "_nth", block_rows)
    spread = layout.with_halo(number_rows(ends, keys, "pos", block_rows, "_nth"), before=near, after=near - 1)
    w = layout.window()
    left = F.array_join(F.collect_list("_tail").over(w.rowsBetween(-near, -1)), "\n")
    right = F.array_join(F.collect_list("_head").over(w.rowsBetween(0, near - 1)), "\n")
    met = F.exists(
        F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in dict.fromkeys(cuts)]),
        lambda c: F.endswith(F.col("_left"), c["a"]) & F.startswith(F.col("_right"), c["b"]),
    )
    borders = (
        spread.withColumns({"_left": left, "_right": right})
        .filter(~F.col("_halo"))
        .select(*layout.cells, "pos", "_nth", ((F.col("_nth") > 0) & met).alias("_tied"))
    )
    start = F.when(~F.col("_tied"), F.col("pos"))
    carried = layout.carry(borders, last={"_before": start}, reuse=True)
    runs = carried.withColumn("_first", layout.running_last(start, F.col("_before"))).filter("_tied").select(*keys, "pos", "_first")
    return (
        rows.join(runs, [*keys, "pos"], "left")
        .groupBy(*keys, F.coalesce("_first", "pos").alias("_at"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_rows"), F.sum("hits").alias("hits"))
        .select(*keys, F.col("_at").alias("pos"), F.array_join(F.transform("_rows", lambda r: r["text"]), "\n").alias("text"), "hits")
    )


def outbound(messages: DataFrame, cfg: PruneConfig, vault: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Masked texts that leave with each session, row by row: `zone`, `pos`, `text`, `hits`, `clean`.

    Rows are masked one by one; those that a secret runs over, line breaks between messages included, are put together first.
    So this finds what masking the whole context would, and a task holds no more text than such a run of rows.
    A value that can match inside a mask is looked for again, on the rows masked so far.
    """
    group = [*keys, "zone"]
    kept = prune.decide(messages, cfg).filter(F.col("keep") | (F.col("zone") != "history"))
    rows = kept.select(*group, "pos", F.coalesce("text", F.lit("")).alias("text"), F.lit(0).cast("bigint").alias("hits"))
    secrets = [str(s) for s in vault if s]
    again = [s for s in secrets if "\n" in s and _meets_mask(s)]
    rounds: list[list[str]] = [[]]
    for s in secrets:
        if s in again and rounds[-1]:
            rounds.append([])
        rounds[-1].append(s)
    for some in rounds:
        rows = tied_rows(rows, some, group, cfg.block_rows).withColumn("_r", X.redact(F.col("text"), some))
        rows = rows.select(*group, "pos", F.col("_r.text").alias("text"), (F.col("hits") + F.col("_r.hits")).alias("hits"))
    return tied_rows(rows, again, group, cfg.block_rows).withColumn("clean", ~X.leaks(F.col("text"), secrets))


def hardened_report(messages: DataFrame, cfg: PruneConfig, vault: Sequence[str], *, keys: Sequence[str] = ("session_id",),
                    threshold: float = ALERT_THRESHOLD) -> DataFrame:
    """One row per session: flood score of history and query, pruning result, redactions, clean flag.

    Input rows: session_id, pos, n, role, signal, text, zone ("history", "query" or "system"). The
    system text and the query are redacted but never pruned and never counted in the token totals.
    """
    messages = cut(messages)  # read by every part of the report
    history = messages.filter(F.col("zone") == "history")
    payload = messages.filter(F.col("zone") != "system")
    flood = session_flood(payload, keys, block_rows=cfg.block_rows).select(*keys, "score")
    sizes = prune.session_audit(
        prune.decide(history, cfg).select(*keys, "keep", "stable", T.token_size(F.col("text")).alias("tokens")), keys
    ).select(*keys, "tokens_before", "tokens_after", "reduction")
    hits = outbound(messages, cfg, vault, keys).groupBy(*keys).agg(
        F.sum("hits").alias("secrets_redacted"), F.bool_and("clean").alias("outbound_clean")
    )
    report = flood.join(hits, list(keys), "full").join(sizes, list(keys), "left")
    score = F.coalesce(F.col("score"), F.lit(0.0))
    return report.select(
        *keys,
        F.bround(score, 4).alias("saturation"),
        (score >= threshold).alias("red_alert"),
        F.coalesce("secrets_redacted", F.lit(0)).alias("secrets_redacted"),
        F.coalesce("outbound_clean", F.lit(True)).alias("outbound_clean"),
        F.coalesce("tokens_before", F.lit(0)).alias("tokens_before"),
        F.coalesce("tokens_after", F.lit(0)).alias("tokens_after"),
        F.coalesce("reduction", F.lit(0.0)).alias("reduction"),
    )


def hardened_prompts(messages: DataFrame, cfg: PruneConfig, vault: Sequence[str], *, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Masked prompts of the sessions, in parts (see prune.prompts), each with the masked system text."""
    texts = prune.render(outbound(cut(messages), cfg, vault, keys), [*keys, "zone"], part_rows=cfg.block_rows or BLOCK_ROWS)
    zone = lambda name, alias: texts.filter(F.col("zone") == name).select(*keys, "part", F.col("context").alias(alias))
    asked = prune.prompts(zone("history", "context"), zone("query", "request").drop("part"), keys)
    return asked.join(zone("system", "system").drop("part"), list(keys), "left")


def hardened_responses(responses: DataFrame, report: DataFrame, vault: Sequence[str], keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Masked answers; their hits add to the session's, and a leak spoils its clean flag."""
    done = redacted(responses, vault)
    joined = done.join(report.select(*keys, "secrets_redacted", "outbound_clean"), list(keys))
    return joined.withColumns(
        {
            "secrets_redacted": F.col("secrets_redacted") + F.col("hits"),
            "outbound_clean": F.col("outbound_clean") & F.col("clean"),
        }
    ).drop("hits", "clean")
