"""Purge units: messages that live or die together, the zones they fall into, and their audit.

Input rows are flat messages: session_id, pos (dense), role, text and the flags that
`flatten_messages` derives from structured content. Plain text tables can start from
`plain_messages`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.config import NON_TEXT_PART_TOKENS, PruneConfig
from palimpsest.functions import text as T
from palimpsest.functions.classes import class_of_unit, is_tagged_fact, looks_durable, survives
from palimpsest.operators.prune import reduction
from palimpsest.operators.sequence import Layout

KEYS = ["session_id"]

MESSAGE_SCHEMA = (
    "session_id STRING, pos BIGINT, role STRING, content STRING, mark STRING, "
    "parts ARRAY<STRUCT<type: STRING, text: STRING, cache_control: BOOLEAN, id: STRING, tool_use_id: STRING>>, "
    "tool_calls ARRAY<STRUCT<id: STRING, function: STRING>>"
)


def plain_messages(df: DataFrame, *, has_calls: Column | None = None, has_use: Column | None = None,
                   has_result: Column | None = None, cached: Column | None = None) -> DataFrame:
    """Flags for tables whose content is one string."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = F.array().cast("array<string>")
    false = F.lit(False)
    return df.withColumns(
        {
            "tagged": is_tagged_fact(text),
            "durable": looks_durable(text),
            "size_bytes": F.octet_length(text).cast("bigint"),
            "size_chars": F.char_length(text).cast("bigint"),
            "size_pieces": F.lit(1).cast("bigint"),
            "has_calls": false if has_calls is None else has_calls,
            "has_use": false if has_use is None else has_use,
            "has_result": false if has_result is None else has_result,
            "cached": false if cached is None else cached,
            "use_ids": ids,
            "result_ids": ids,
        }
    )


def flatten_messages(df: DataFrame) -> DataFrame:
    """Flags and sizes of structured messages (MESSAGE_SCHEMA).

    Text parts count as they are, every other part at a nominal size, and the function of each tool
    call is added; the pieces are joined by newlines, which the unit size accounts for.
    """
    parts, calls = F.col("parts"), F.col("tool_calls")
    some_parts = F.coalesce(parts, F.array().cast(df.schema["parts"].dataType))
    some_calls = F.coalesce(calls, F.array().cast(df.schema["tool_calls"].dataType))
    nominal = NON_TEXT_PART_TOKENS * 4
    string_content = F.col("content").isNotNull()

    def measure(length) -> Column:
        own = F.when(string_content, length(F.col("content")).cast("bigint")).otherwise(
            F.aggregate(
                some_parts,
                F.lit(0).cast("bigint"),
                lambda acc, p: acc
                + F.when(p["type"] == "text", length(F.coalesce(p["text"], F.lit(""))).cast("bigint")).otherwise(
                    F.lit(nominal).cast("bigint")
                ),
            )
        )
        return own + F.aggregate(
            some_calls,
            F.lit(0).cast("bigint"),
            lambda acc, c: acc + length(F.coalesce(c["function"], F.lit("{}"))).cast("bigint"),
        )

    def of_type(kind: str):
        return lambda p: p["type"] == kind

    first_part = F.get(F.filter(some_parts, of_type("text")), F.lit(0))["text"]
    first_text = F.coalesce(F.col("content"), first_part, F.lit(""))
    return df.withColumns(
        {
            "text": F.coalesce(
                F.col("content"),
                F.array_join(F.transform(F.filter(some_parts, of_type("text")), lambda p: p["text"]), "\n"),
            ),
            "tagged": is_tagged_fact(first_text),
            "durable": looks_durable(first_text),
            "size_bytes": measure(F.octet_length),
            "size_chars": measure(F.char_length),
            "size_pieces": F.when(string_content, F.lit(1)).otherwise(F.size(some_parts)).cast("bigint")
            + F.size(some_calls),
            "has_calls": F.size(some_calls) > 0,
            "has_use": F.exists(some_parts, of_type("tool_use")),
            "has_result": F.exists(some_parts, of_type("tool_result")),
            "cached": F.exists(some_parts, lambda p: F.coalesce(p["cache_control"], F.lit(False))),
            "use_ids": F.transform(F.filter(some_parts, of_type("tool_use")), lambda p: p["id"]),
            "result_ids": F.transform(F.filter(some_parts, of_type("tool_result")), lambda p: p["tool_use_id"]),
        }
    )


def call_run_units(messages: DataFrame, cfg: PruneConfig = PruneConfig()) -> DataFrame:
    """`unit_id` per row: an assistant row with tool calls takes the run of tool rows after it."""
    layout = Layout(KEYS, "pos", cfg.block_rows)
    is_tool = F.col("role").eqNullSafe("tool")
    calls = F.when(~is_tool, F.col("role").eqNullSafe("assistant") & F.coalesce(F.col("has_calls"), F.lit(False)))
    seen = layout.carry(layout.split(messages).withColumn("_calls", calls), last={"_calls_before": F.col("_calls")})
    open_call = layout.running_last(F.col("_calls"), F.col("_calls_before"))
    start = ~(is_tool & F.coalesce(open_call, F.lit(False)))
    return _number_units(seen.withColumn("_start", start).drop("_calls", "_calls_before"), layout)


def paired_units(messages: DataFrame, cfg: PruneConfig = PruneConfig()) -> DataFrame:
    """`unit_id` per row: an assistant row with a tool use pairs with the next row if that has results.

    A row may fit both ends of a pair; the leftmost pair wins. In a run of rows that could all open a
    pair the winners are those at even offsets, so the greedy scan needs no sequential fold.
    """
    layout = Layout(KEYS, "pos", cfg.block_rows)
    has_result = F.coalesce(F.col("has_result"), F.lit(False))
    seen = layout.carry(
        layout.split(messages).withColumn("_result", has_result), first_after={"_result_after": F.col("_result")}
    )
    opens = (
        F.col("role").eqNullSafe("assistant")
        & F.coalesce(F.col("has_use"), F.lit(False))
        & F.coalesce(layout.following_first(F.col("_result"), F.col("_result_after")), F.lit(False))
    )
    closed_at = F.when(~F.col("_opens"), F.col("pos"))
    runs = layout.carry(seen.withColumn("_opens", opens), last={"_closed_before": closed_at}, reuse=True)
    closed = F.coalesce(layout.running_last(closed_at, F.col("_closed_before")), F.lit(-1))
    paired = runs.withColumn("_pairs", F.col("_opens") & ((F.col("pos") - closed - 1) % 2 == 0))
    prior = layout.carry(paired, last={"_pairs_before": F.col("_pairs")}, reuse=True)
    second = layout.running_last(F.col("_pairs"), F.col("_pairs_before"), inclusive=False)
    starts = prior.withColumn("_start", ~F.coalesce(second, F.lit(False)))
    return _number_units(
        starts.drop("_result", "_result_after", "_opens", "_closed_before", "_pairs", "_pairs_before"), layout
    )


def _number_units(rows: DataFrame, layout: Layout) -> DataFrame:
    one = F.col("_start").cast("bigint")
    counted = layout.carry(rows, sums={"_units_before": one}, reuse=True)
    numbered = counted.withColumn("unit_id", layout.running_sum(one, F.col("_units_before")) - 1)
    return layout.merge(numbered.drop("_start", "_units_before"))


def split_at_query(messages: DataFrame, cfg: PruneConfig = PruneConfig(), *, with_tool_answer: bool = False) -> DataFrame:
    """`split`: position from which rows belong to the current query; null without a user row.

    The query starts at the last user row. With `with_tool_answer` it starts one row earlier when that
    row answers a tool use of the assistant row before it.
    """
    layout = Layout(KEYS, "pos", cfg.block_rows)
    rows = layout.split(messages)
    is_user = F.col("role").eqNullSafe("user")
    if not with_tool_answer:
        return layout.merge(layout.carry(rows, final={"split": F.when(is_user, F.col("pos"))}))
    uses = F.col("role").eqNullSafe("assistant") & F.coalesce(F.col("has_use"), F.lit(False))
    marked = layout.carry(rows.withColumn("_uses", uses), last={"_uses_before": F.col("_uses")})
    after_use = layout.running_last(F.col("_uses"), F.col("_uses_before"), inclusive=False)
    answers = F.coalesce(F.col("has_result"), F.lit(False)) & F.coalesce(after_use, F.lit(False))
    start = F.when(is_user, F.struct(F.col("pos").alias("at"), answers.alias("answers")))
    ends = layout.carry(marked.withColumn("_start_at", start), final={"_end": F.col("_start_at")}, reuse=True)
    split = F.col("_end.at") - F.when(F.col("_end.answers"), 1).otherwise(0)
    return layout.merge(ends.withColumn("split", split).drop("_uses", "_uses_before", "_start_at", "_end"))


def build_units(grouped: DataFrame, cfg: PruneConfig = PruneConfig(), *, include_marker: bool = False) -> DataFrame:
    """One row per unit: class, size and cache flag. Sizes are summed, never concatenated.

    include_marker also counts the `[U<n>]` label some gateways put in front of each unit.
    """
    # Only with auto_fact is the durable pattern evaluated at all.
    flags = ["role", "tagged", "cached", *(["durable"] if cfg.auto_fact else [])]
    first = F.min_by(F.struct(*flags), F.col("pos"))
    tool_row = (
        F.col("role").eqNullSafe("tool") | F.col("has_calls") | F.col("has_use") | F.col("has_result")
    )
    newlines = F.greatest(F.sum("size_pieces") - 1, F.lit(0))
    units = grouped.groupBy(*KEYS, "unit_id").agg(
        F.min("pos").alias("first_pos"),
        F.count(F.lit(1)).alias("messages"),
        first.alias("_first"),
        F.bool_or(tool_row).alias("is_tool"),
        F.bool_or("cached").alias("cached"),
        (F.sum("size_bytes") + newlines).alias("unit_bytes"),
        (F.sum("size_chars") + newlines).alias("unit_chars"),
        F.max("split").alias("split"),
    )
    marker = F.length(F.col("unit_id").cast("string")) + 3 if include_marker else F.lit(0)
    return units.select(
        *KEYS,
        "unit_id",
        "first_pos",
        "messages",
        "cached",
        "split",
        class_of_unit(
            F.coalesce(F.col("_first.role"), F.lit("user")),
            F.col("_first.tagged") | F.col("_first.cached"),
            F.col("is_tool"),
            F.col("_first.durable") if cfg.auto_fact else F.lit(False),
        ).alias("signal"),
        T.token_size_of_bytes(F.col("unit_bytes") + marker).alias("tokens"),
        F.floor(F.col("unit_chars") / 4).cast("bigint").alias("frozen_tokens"),
    )


def decide_units(units: DataFrame, cfg: PruneConfig) -> DataFrame:
    """Zone and fate of every unit, with the session totals that the hysteresis needs.

    Zones: pass (session without a user row), tail (current query), frozen (above the quantum
    boundary), stable (cache prefix), mobile (subject to pruning). Ages count back from the boundary.
    """
    layout = Layout(KEYS, "unit_id", cfg.block_rows)
    history = F.col("first_pos") < F.col("split")
    known = layout.carry(
        layout.split(units),
        totals={"history_units": F.when(history, F.lit(1)).otherwise(F.lit(0))},
        first={"first_cached": F.when(history & F.col("cached"), F.col("unit_id"))},
        reuse=True,
    )
    n = F.col("history_units")
    boundary = (F.floor(n / cfg.quantum) * cfg.quantum).cast("bigint") if cfg.quantum else n
    auto = F.coalesce(F.col("first_cached") + 1, F.lit(0))
    prefix = auto if cfg.stable_prefix < 0 else F.lit(cfg.stable_prefix)
    if cfg.anchor_first:
        prefix = F.greatest(prefix, F.lit(1))
    known = known.withColumns({"boundary": boundary, "stable_units": F.least(prefix, boundary)})
    zone = (
        F.when(F.col("split").isNull(), "pass")
        .when(~history, "tail")
        .when(F.col("unit_id") >= F.col("boundary"), "frozen")
        .when(F.col("unit_id") < F.col("stable_units"), "stable")
        .otherwise("mobile")
    )
    age = F.col("boundary") - 1 - F.col("unit_id")
    decided = known.withColumn("zone", zone).withColumn(
        "keep", (F.col("zone") != "mobile") | survives(F.col("signal"), age, cfg)
    )
    active = F.col("zone").isin("stable", "mobile")
    frozen = F.when(F.col("zone") == "frozen", F.col("frozen_tokens")).otherwise(0)
    before = F.when(active, F.col("tokens")).otherwise(0) + frozen
    after = F.when(active & F.col("keep"), F.col("tokens")).otherwise(0) + frozen
    sized = decided.withColumns({"before": before, "after": after})
    if cfg.hysteresis <= 0:
        return layout.merge(sized).withColumn("held", F.lit(False))
    totals = layout.carry(
        sized,
        totals={"session_before": F.col("before"), "session_after": F.col("after")},
        reuse=True,
    )
    potential = reduction(F.col("session_before"), F.col("session_after"))
    return layout.merge(totals).withColumn("held", potential < cfg.hysteresis)


def unit_audit(decided: DataFrame) -> DataFrame:
    """Audit row per session, taken before any repair; held sessions report no purge."""
    gone = ~F.col("keep")
    sums = decided.groupBy(*KEYS).agg(
        F.count_if(F.col("zone").isin("stable", "mobile")).alias("units_in"),
        F.count_if(gone).alias("_purged"),
        F.sum("before").alias("tokens_before"),
        F.sum("after").alias("_after"),
        F.count_if(F.col("zone") == "frozen").alias("frozen_units"),
        F.coalesce(F.sum(F.when(F.col("zone") == "stable", F.col("tokens"))), F.lit(0)).alias(
            "stable_prefix_tokens"
        ),
        F.bool_or("held").alias("held"),
    )
    potential = reduction(F.col("tokens_before"), F.col("_after"))
    held = F.col("held")
    return sums.select(
        *KEYS,
        "units_in",
        F.when(held, F.lit(0)).otherwise(F.col("_purged")).alias("blocks_purged"),
        "tokens_before",
        F.when(held, F.col("tokens_before")).otherwise(F.col("_after")).alias("tokens_after"),
        F.when(held, F.lit(0.0)).otherwise(potential).alias("reduction"),
        "stable_prefix_tokens",
        "frozen_units",
        "held",
        F.when(held, F.bround(potential, 4)).alias("potential_reduction"),
    )


def reassemble(grouped: DataFrame, decided: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """Kept messages of every zone with their order column; held sessions come back whole.

    Decisions run on narrow rows; `messages` brings the texts back, by position, for kept rows only.
    """
    kept = decided.filter(F.col("keep") | F.col("held")).select(*KEYS, "unit_id", "zone")
    return _with_texts(grouped.join(kept, [*KEYS, "unit_id"]), messages)


def purged_messages(grouped: DataFrame, decided: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    gone = decided.filter(~F.col("keep") & ~F.col("held")).select(*KEYS, "unit_id")
    return _with_texts(grouped.join(gone, [*KEYS, "unit_id"], "left_semi"), messages)


def _with_texts(rows: DataFrame, messages: DataFrame | None) -> DataFrame:
    if messages is None:
        return rows
    return rows.join(messages.select(*KEYS, "pos", *[c for c in messages.columns if c not in rows.columns]), [*KEYS, "pos"])


NARROW = [
    "session_id", "pos", "role", "tagged", "durable", "cached", "has_calls", "has_use", "has_result",
    "size_bytes", "size_chars", "size_pieces",
]


def gateway_plan(messages: DataFrame, cfg: PruneConfig, surface: str = "chat") -> tuple[DataFrame, DataFrame]:
    """Grouped messages and unit decisions for one of the two message surfaces.

    chat: tool calls and tool rows. blocks: tool_use and tool_result content blocks; its first unit
    always stays, so that the session still opens with the user's first turn.
    """
    if surface not in ("chat", "blocks"):
        raise ValueError(f"unknown surface {surface!r}")
    blocks = surface == "blocks"
    cfg = cfg.with_(anchor_first=cfg.anchor_first or blocks)
    split = split_at_query(messages.select(*NARROW), cfg, with_tool_answer=blocks)
    grouped = paired_units(split, cfg) if blocks else call_run_units(split, cfg)
    return grouped, decide_units(build_units(grouped, cfg), cfg)
