"""Cycle-based decay, reclaimed tokens, and the bounded state list that purged turns leave behind."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest import config as C
from palimpsest.config import BLOCK_ROWS
from palimpsest.functions import text as T
from palimpsest.functions.classes import has_flag, weight_of
from palimpsest.operators.lineage import cut
from palimpsest.operators.sequence import Layout, number_rows

KEYS = ["session_id"]

# Defaults of the cycle-based form.
CYCLE_HALF_LIFE = 2.0
CYCLE_THRESHOLD = 0.35
REINFORCEMENT = 0.5
STATE_CAPACITY = 64


def initial_level(signal: Column, oxygen: Column) -> Column:
    """The given level of a block; by its class where none is given or it is negative."""
    return F.when(F.coalesce(oxygen, F.lit(-1.0)) < 0, weight_of(signal)).otherwise(oxygen)


def lifetime(level: Column, signal: Column, half_life: float, threshold: float) -> Column:
    """The number of cycles after which a block falls below the threshold, one at least; null for those that never do."""
    cycles = F.floor(F.log2(level / F.lit(threshold)) * max(half_life, 0.1) + 1e-9) + 1
    ends = F.when(level < threshold, F.lit(1)).otherwise(F.greatest(cycles, F.lit(1)))
    return F.when(~has_flag(signal, C.PROTECTED) & (F.lit(threshold) > 0), ends.cast("bigint"))


def decay_cycles(
    rows: DataFrame,
    *,
    half_life: float = CYCLE_HALF_LIFE,
    threshold: float = CYCLE_THRESHOLD,
    boost: float = REINFORCEMENT,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Oxygen of every inserted block after all decay cycles of its session, and the cycle that purged it.

    Input: session_id, pos, is_cycle, signal, text, oxygen (null or negative: by class). A cycle acts on
    the blocks inserted before it, so the state is a closed form of the number of cycles since then.
    """
    life = max(half_life, 0.1)
    cycle = F.when(F.col("is_cycle"), 1).otherwise(0)
    layout = Layout(KEYS, "pos", block_rows)
    counted = layout.carry(
        layout.split(rows), sums={"_cycles_before": cycle}, totals={"total_cycles": cycle}
    )
    born = layout.running_sum(cycle, F.col("_cycles_before"))
    start = initial_level(F.col("signal"), F.col("oxygen"))
    blocks = counted.withColumn("born_cycle", born).filter(~F.col("is_cycle"))
    cycles = F.col("total_cycles") - F.col("born_cycle")
    protected = has_flag(F.col("signal"), C.PROTECTED)
    return layout.merge(
        blocks.withColumns({"_start": start, "cycles": cycles})
        .withColumn("_lifetime", lifetime(F.col("_start"), F.col("signal"), half_life, threshold))
        .withColumn(
            "purged_cycle",
            F.when(F.col("_lifetime") <= F.col("cycles"), F.col("born_cycle") + F.col("_lifetime")),
        )
        .withColumn(
            "level",
            F.when(protected, F.col("_start") + boost * F.col("cycles")).otherwise(
                F.col("_start") * F.pow(F.lit(2.0), -F.col("cycles") / F.lit(life))
            ),
        )
        .withColumn("alive", F.col("purged_cycle").isNull())
        .drop("_cycles_before", "_start", "_lifetime", "total_cycles")
    )


def reclaimed_ratio(rows: DataFrame, decayed: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per decay cycle: tokens inserted and reclaimed so far, and their ratio."""
    token = T.token_size(F.col("text"))
    layout = Layout(KEYS, "pos", block_rows)
    narrow = rows.select(*KEYS, "pos", "is_cycle", F.when(~F.col("is_cycle"), token).otherwise(0).alias("tok"))
    inserted = layout.carry(
        layout.split(narrow), sums={"_tok": F.col("tok"), "_cycle": F.col("is_cycle").cast("int")}
    )
    cycles = inserted.select(
        *KEYS,
        "is_cycle",
        layout.running_sum(F.col("is_cycle").cast("int"), F.col("_cycle")).alias("cycle"),
        layout.running_sum(F.col("tok"), F.col("_tok")).alias("inserted_tokens"),
    ).filter("is_cycle")
    freed = (
        decayed.filter(F.col("purged_cycle").isNotNull())
        .groupBy(*KEYS, F.col("purged_cycle").alias("cycle"))
        .agg(F.sum(token).alias("_freed"))
    )
    by_cycle = Layout(KEYS, "cycle", block_rows)
    total = by_cycle.carry(
        by_cycle.split(cycles.join(freed, [*KEYS, "cycle"], "left")),
        sums={"_freed_before": F.col("_freed")},
        reuse=True,
    )
    return total.select(
        *KEYS,
        "cycle",
        "inserted_tokens",
        by_cycle.running_sum(F.col("_freed"), F.col("_freed_before")).alias("reclaimed_tokens"),
    ).withColumn(
        "ratio",
        F.when(F.col("inserted_tokens") > 0, F.col("reclaimed_tokens") / F.col("inserted_tokens")).otherwise(0.0),
    )


def state_list(facts: DataFrame, capacity: int = STATE_CAPACITY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Final state per session: facts in insertion order, without one that is currently held, newest
    `capacity` kept; an evicted fact may come back. Input: session_id, ord (dense), fact.

    The list is a fold, but most of its input cannot matter. A first occurrence is always inserted, so
    `capacity` first occurrences in a row fix the state whatever came before; the fold starts at the
    last such run. A session with no more than `capacity` distinct facts never evicts, and only its
    first occurrences count. What is left is folded in order, streamed in Arrow batches: the state is
    `capacity` strings, never the session.
    """
    capacity = max(int(capacity), 1)
    # Read several times below; narrow, and stored once instead of derived again each time.
    facts = cut(facts.select(*KEYS, "ord", "fact"))
    firsts = facts.groupBy(*KEYS, "fact").agg(F.min("ord").alias("ord"))
    # Distinct facts are numbered in order; in a run of neighbours, rank and ord stay in step.
    first_rows = number_rows(firsts.withColumnRenamed("ord", "at"), KEYS, "at", block_rows, "ord")
    runs = first_rows.groupBy(*KEYS, (F.col("at") - F.col("ord")).alias("gap")).agg(
        F.count(F.lit(1)).alias("length"), F.max("at").alias("end")
    )
    sync = runs.filter(F.col("length") >= capacity).groupBy(*KEYS).agg(
        (F.max("end") - capacity + 1).alias("_sync")
    )
    few = firsts.groupBy(*KEYS).agg((F.count(F.lit(1)) <= capacity).alias("_few"))
    limits = few.join(sync, KEYS, "left")

    # Spread the limits over the blocks of the session instead of joining on a possibly hot session key.
    marks = facts.withColumn("_mark", F.lit(False)).select(*KEYS, "ord", "fact", "_mark")
    limit_rows = limits.select(
        *KEYS,
        F.coalesce(F.col("_sync"), F.lit(0)).alias("ord"),
        F.when(F.col("_few"), "few").otherwise("many").alias("fact"),
        F.lit(True).alias("_mark"),
    )
    layout = Layout(KEYS, "ord", block_rows)
    flagged = layout.carry(
        layout.split(marks.unionByName(limit_rows)),
        final={
            "_from": F.when(F.col("_mark"), F.col("ord")),
            "_kind": F.when(F.col("_mark"), F.col("fact")),
        },
    ).filter(~F.col("_mark"))
    suffix = flagged.filter((F.col("_kind") == "many") & (F.col("ord") >= F.col("_from"))).select(
        *KEYS, "ord", "fact"
    )
    distinct_only = firsts.join(limits.filter("_few"), KEYS, "left_semi").select(*KEYS, "ord", "fact")
    steps = suffix.unionByName(distinct_only)

    def fold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        for batch in batches:
            for fact in batch.column("fact").to_pylist():
                if fact not in held:
                    held.append(fact)
                    if len(held) > capacity:
                        held.pop(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], type=key[0].type), pa.array([held], type=pa.list_(pa.string()))],
            names=["session_id", "state"],
        )

    key_type = facts.schema["session_id"].dataType.simpleString()
    return (
        steps.repartition(*KEYS)
        .sortWithinPartitions(*KEYS, "ord")
        .groupBy(*KEYS)
        .applyInArrow(fold, f"session_id {key_type}, state array<string>")
    )


def render_state(header: str | None, state, context):
    """Stable header, state list, then the surviving context."""
    lines = F.transform(state, lambda s: F.concat(F.lit("- "), s, F.lit("\n")))
    block = F.when(F.size(state) > 0, F.concat(F.lit("STATE:\n"), F.array_join(lines, ""))).otherwise(F.lit(""))
    top = F.lit("" if header is None else header + "\n")
    return F.concat(top, F.coalesce(block, F.lit("")), F.coalesce(context, F.lit("")))


def absorbed_digests(decayed: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Digests of purged user and assistant blocks in purge order (cycle, then position)."""
    talk = has_flag(F.col("signal"), C.USER | C.ASSISTANT)
    gone = decayed.filter(F.col("purged_cycle").isNotNull() & talk).select(
        *KEYS, "purged_cycle", "pos", T.one_line_digest(F.col("text")).alias("fact")
    )
    cells = Window.partitionBy(*KEYS, "purged_cycle").orderBy("pos")
    per_cycle = gone.groupBy(*KEYS, "purged_cycle").agg(F.count(F.lit(1)).alias("_rows"))
    layout = Layout(KEYS, "purged_cycle", block_rows)
    starts = layout.carry(layout.split(per_cycle), sums={"_before": F.col("_rows")})
    start = layout.running_sum(F.col("_rows"), F.col("_before"), inclusive=False)
    offsets = starts.select(*KEYS, "purged_cycle", start.alias("_start"))
    return gone.join(offsets, [*KEYS, "purged_cycle"]).select(
        *KEYS, (F.col("_start") + F.row_number().over(cells) - 1).cast("bigint").alias("ord"), "fact"
    )


def render_sessions(purpose: str, sessions: DataFrame, held: DataFrame, parts: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Prompts of all sessions, in the parts of `prune.render`: purpose and state stand before the first part.

    A session without state has none shown, and one without survivors is purpose and state alone.
    """
    first = parts.groupBy(*keys).agg(F.min("part").alias("_first"))
    rows = sessions.select(*keys).distinct().join(held, list(keys), "left").join(first, list(keys), "left").join(parts, list(keys), "left")
    state, context = F.coalesce("state", F.array().cast("array<string>")), F.coalesce("context", F.lit(""))
    part = F.coalesce(F.col("part") - F.col("_first"), F.lit(0))
    return rows.select(*keys, part.alias("part"), F.when(part == 0, render_state(purpose, state, context)).otherwise(context).alias("prompt"))
