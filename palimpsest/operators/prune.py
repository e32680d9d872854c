"""Threshold pruning of whole sessions: decide, split, audit, render."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.config import BLOCK_ROWS, PruneConfig
from palimpsest.functions import text as T
from palimpsest.functions.classes import survives
from palimpsest.operators.sequence import Layout

KEYS = ("session_id",)


def decide(messages: DataFrame, cfg: PruneConfig) -> DataFrame:
    """Mark the rows that stay. Needs `pos`, `n` (session size) and `signal`; touches no text.

    With dense positions and a known size the age is `n - 1 - pos`, so the decision is a filter
    expression: no window and no shuffle.
    """
    age = F.col("n") - 1 - F.col("pos")
    stable = F.col("pos") < max(cfg.stable_prefix, 0)
    return messages.withColumns(
        {"age": age, "stable": stable, "keep": stable | survives(F.col("signal"), age, cfg)}
    )


def reduction(before: Column, after: Column) -> Column:
    """Share of tokens removed; 0 for an empty input."""
    return F.when(before > 0, 1.0 - after / before).otherwise(F.lit(0.0))


def session_audit(decided: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per session. Sums combine on the map side, so a hot session costs one row per task."""
    tokens = F.col("tokens") if "tokens" in decided.columns else T.token_size(F.col("text"))
    sized = decided.select(*keys, "keep", "stable", tokens.alias("_tok"))
    kept = F.col("keep")
    totals = sized.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("blocks_in"),
        F.count_if(kept).alias("blocks_kept"),
        F.count_if(~kept).alias("blocks_purged"),
        F.sum("_tok").alias("tokens_before"),
        F.coalesce(F.sum(F.when(kept, F.col("_tok"))), F.lit(0)).alias("tokens_after"),
        F.coalesce(F.sum(F.when(F.col("stable"), F.col("_tok"))), F.lit(0)).alias("stable_prefix_tokens"),
    )
    return totals.withColumn("reduction", reduction(F.col("tokens_before"), F.col("tokens_after")))


def survivors(decided: DataFrame) -> DataFrame:
    return decided.filter("keep")


def purged(decided: DataFrame) -> DataFrame:
    return decided.filter(~F.col("keep"))


def render(
    kept: DataFrame,
    keys: Sequence[str] = KEYS,
    *,
    pos: str = "pos",
    text: str = "text",
    part_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Kept texts joined by newlines, in order.

    A session that spans up to `part_rows` positions gives one row, `part` 0. Longer ones give
    several; joining their texts by newline in `part` order is the whole context, so no task ever
    holds an unbounded session.
    """
    part = F.floor(F.col(pos) / part_rows).cast("bigint")
    return (
        kept.select(*keys, part.alias("part"), F.struct(F.col(pos).alias("p"), F.col(text).alias("t")).alias("_r"))
        .groupBy(*keys, "part")
        .agg(F.array_sort(F.collect_list("_r")).alias("_rows"))
        .select(
            *keys,
            "part",
            F.array_join(F.transform("_rows", lambda r: F.coalesce(r["t"], F.lit(""))), "\n").alias("context"),
        )
    )


def assemble_prompt(context: Column, request: Column) -> Column:
    """Context and request under their headings; the request alone when no context is left."""
    return F.when(
        F.coalesce(context, F.lit("")) != "",
        F.concat(F.lit("Context:\n"), context, F.lit("\n\nRequest:\n"), request),
    ).otherwise(request)


def prompts(parts: DataFrame, requests: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Prompts from `render` parts and one request text per session.

    The heading goes to the first part and the request to the last; a session of one part gets the
    finished prompt in one row.
    """
    ends = parts.groupBy(*keys).agg(F.min("part").alias("_low"), F.max("part").alias("_high"))
    joined = requests.join(ends, list(keys), "left").join(parts, list(keys), "left")
    empty = F.coalesce(F.col("context"), F.lit("")) == ""
    alone = F.col("_low").isNull() | ((F.col("_low") == F.col("_high")) & empty)
    head = F.when(F.col("part") == F.col("_low"), F.lit("Context:\n")).otherwise(F.lit("\n"))
    tail = F.when(
        F.col("part") == F.col("_high"), F.concat(F.lit("\n\nRequest:\n"), F.col("request"))
    ).otherwise(F.lit(""))
    return joined.select(
        *keys,
        (F.coalesce(F.col("part"), F.lit(0)) - F.coalesce(F.col("_low"), F.lit(0))).alias("part"),
        F.when(alone, F.col("request")).otherwise(F.concat(head, F.col("context"), tail)).alias("prompt"),
    )


def deletion_only_violations(before: DataFrame, after: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of the output that the input does not hold at the same place; must be empty.

    Rows meet by key, position and a digest of their content, so the input's texts are not shuffled.
    """
    content = F.sha2(F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}), 256)
    places = [*keys, "pos"]
    held = before.select(*places, content.alias("_content"))
    rows = after.select(*places, "role", "text", content.alias("_content"))
    same = [rows[c].eqNullSafe(held[c]) for c in places] + [rows["_content"] == held["_content"]]
    return rows.join(held, on=same, how="left_anti").drop("_content")


def order_violations(after: DataFrame, place: str = "place", keys: Sequence[str] = KEYS, block_rows: int = 0) -> DataFrame:
    """Rows of the output, in the order of `place`, that stand behind a later row of the input; must be empty."""
    layout = Layout(list(keys), place, block_rows)
    rows = layout.carry(layout.split(after), last={"_before": F.col("pos")}, reuse=True)
    before = layout.running_last(F.col("pos"), F.col("_before"), inclusive=False)
    return layout.merge(rows.withColumn("_previous", before).filter("_previous > pos").drop("_before", "_previous"))


def hold_small_purges(audit: DataFrame, hysteresis: float) -> DataFrame:
    """Audit rows whose purge saves too little report an untouched session instead."""
    small = (F.lit(hysteresis) > 0) & (F.col("reduction") < hysteresis)
    return audit.withColumns(
        {
            "held": small,
            "potential_reduction": F.when(small, F.bround("reduction", 4)),
            "tokens_after": F.when(small, F.col("tokens_before")).otherwise(F.col("tokens_after")),
            "blocks_purged": F.when(small, F.lit(0)).otherwise(F.col("blocks_purged")),
            "reduction": F.when(small, F.lit(0.0)).otherwise(F.col("reduction")),
        }
    )
