"""Growing sessions: what each request would have cost, with and without pruning.

A client resends the whole session at every turn. Joining each request with its prefix would be
quadratic in the session. Instead, every class survives for a fixed number of positions, so the
tokens kept for the prefix [0, q) are running sums (rows that always stay) plus sums over bounded
frames (rows younger than the cut-off of their class): linear work, one shuffle by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import PruneConfig
from palimpsest.functions import text as T
from palimpsest.functions.classes import cutoff_of
from palimpsest.operators.prune import reduction
from palimpsest.operators.sequence import Layout

KEYS = ["session_id"]


def _cutoffs(cfg: PruneConfig) -> list[int]:
    """Distinct finite cut-off ages of the unprotected classes."""
    from palimpsest import config as C

    ages = {cfg.cutoff_age(w) for w in (C.WEIGHT_TALK, C.WEIGHT_THINKING, C.WEIGHT_TOOL, C.WEIGHT_OTHER)}
    return sorted(a for a in ages if a is not None and a >= 0)


def prefix_states(messages: DataFrame, cfg: PruneConfig, *, inclusive: bool) -> DataFrame:
    """Per row: sizes of the prefix that ends at it (inclusive) or just before it, full and pruned.

    Input columns: session_id, pos, role, signal, and tokens and frozen_tokens or text. Output adds full, kept (tokens), kept_rows
    and frozen_full (characters div 4).
    """
    if cfg.stable_prefix < 0:
        raise ValueError("replay needs a fixed stable_prefix")
    stable = F.col("pos") < cfg.stable_prefix
    cut = F.when(stable, F.lit(None)).otherwise(cutoff_of(F.col("signal"), cfg))
    narrow = messages.select(
        *KEYS,
        "pos",
        "role",
        cut.alias("cut"),
        (F.col("tokens") if "tokens" in messages.columns else T.token_size(F.col("text"))).alias("tok"),
        (F.col("frozen_tokens") if "frozen_tokens" in messages.columns else T.char_quarter(F.col("text"))).alias("frozen"),
    )
    layout = Layout(KEYS, "pos", cfg.block_rows)
    always = F.col("cut").isNull()
    fixed = layout.carry(
        layout.split(narrow),
        sums={
            "_full": F.col("tok"),
            "_always": F.when(always, F.col("tok")),
            "_always_rows": F.when(always, F.lit(1)),
            "_frozen": F.col("frozen"),
        },
    )
    cutoffs = _cutoffs(cfg)
    shift = 0 if inclusive else 1
    # Copied rows only feed the bounded frames; the carried sums are read from a block's own rows.
    spread = layout.with_halo(layout.merge(fixed), before=max(cutoffs) + shift if cutoffs else 0)
    w = layout.window()
    own = ~F.col("_halo")

    def up_to_row(value: Column, carried: str) -> Column:
        frame = w.rowsBetween(Window.unboundedPreceding, -shift)
        return F.col(carried) + F.coalesce(F.sum(F.when(own, value)).over(frame), F.lit(0))

    kept = up_to_row(F.when(always, F.col("tok")), "_always")
    kept_rows = up_to_row(F.when(always, F.lit(1)), "_always_rows")
    for age in cutoffs:
        frame = w.rowsBetween(-(age + shift), -shift)
        same = F.col("cut") == age
        kept = kept + F.coalesce(F.sum(F.when(same, F.col("tok"))).over(frame), F.lit(0))
        kept_rows = kept_rows + F.coalesce(F.sum(F.when(same, F.lit(1))).over(frame), F.lit(0))
    states = spread.withColumns(
        {
            "full": up_to_row(F.col("tok"), "_full"),
            "frozen_full": up_to_row(F.col("frozen"), "_frozen"),
            "kept": kept,
            "kept_rows": kept_rows,
        }
    )
    return states.filter(own).select(
        *KEYS, "pos", "role", "full", "frozen_full", "kept", "kept_rows", "tok"
    )


def replay_requests(messages: DataFrame, cfg: PruneConfig) -> DataFrame:
    """One audit row per user turn: the prefix before it, pruned as the request would be."""
    states = prefix_states(messages, cfg, inclusive=False)
    is_user = F.col("role").eqNullSafe("user")
    q = F.col("pos")
    if cfg.quantum:
        edge = states.filter(q % cfg.quantum == 0).select(
            *KEYS,
            q.alias("boundary"),
            F.col("full").alias("_full"),
            F.col("kept").alias("_kept"),
            F.col("kept_rows").alias("_kept_rows"),
            F.col("frozen_full").alias("_frozen"),
        )
        states = states.withColumn("boundary", q - q % cfg.quantum).join(edge, [*KEYS, "boundary"])
        frozen = F.col("frozen_full") - F.col("_frozen")
        before, after = F.col("_full") + frozen, F.col("_kept") + frozen
        purged = F.col("boundary") - F.col("_kept_rows")
        frozen_rows = q - F.col("boundary")
    else:
        before, after, purged = F.col("full"), F.col("kept"), q - F.col("kept_rows")
        frozen_rows = F.lit(0).cast("bigint")
    layout = Layout(KEYS, "pos", cfg.block_rows)
    counted = layout.carry(
        layout.split(
            states.select(
                *KEYS,
                "pos",
                is_user.alias("_user"),
                "tok",
                before.alias("tokens_before"),
                after.alias("tokens_after"),
                purged.alias("blocks_purged"),
                frozen_rows.alias("frozen_units"),
            ),
        ),
        sums={"_before": F.when(F.col("_user"), F.lit(1))},
        reuse=True,
    )
    number = layout.running_sum(F.when(F.col("_user"), F.lit(1)), F.col("_before"))
    return (
        counted.withColumn("request_no", number)
        .filter("_user")
        .select(
            *KEYS,
            "request_no",
            F.col("pos").alias("request_pos"),
            F.col("tok").alias("request_tokens"),
            "tokens_before",
            "tokens_after",
            "blocks_purged",
            "frozen_units",
            reduction(F.col("tokens_before"), F.col("tokens_after")).alias("reduction"),
        )
    )


def replay_steps(messages: DataFrame, cfg: PruneConfig, *, base: int, chunk: int, steps: int) -> DataFrame:
    """One audit row per step t: the first min(base + (t - 1) * chunk, n) rows of the session, pruned."""
    if base < 1 or chunk < 1 or steps < 1:
        raise ValueError("base, chunk and steps must be positive")
    cfg = cfg.with_(quantum=0)
    states = prefix_states(messages, cfg, inclusive=True)
    layout = Layout(KEYS, "pos", cfg.block_rows)
    sized = layout.carry(layout.split(states), totals={"n": F.lit(1)}, reuse=True)
    length = F.col("pos") + 1
    step_here = F.floor((length - base) / chunk).cast("bigint") + 1
    on_step = ((length - base) % chunk == 0) & step_here.between(1, steps)
    plateau = F.greatest(F.ceil((F.col("n") - base) / chunk).cast("bigint") + 1, F.lit(1))
    these = F.when(
        (length == F.col("n")) & (plateau <= steps), F.sequence(plateau, F.lit(steps).cast("bigint"))
    ).when((length < F.col("n")) & on_step, F.array(step_here))
    return sized.withColumn("step", F.explode(these)).select(
        *KEYS,
        "step",
        length.alias("history_turns"),
        F.col("full").alias("tokens_before"),
        F.col("kept").alias("tokens_after"),
        (length - F.col("kept_rows")).alias("blocks_purged"),
        reduction(F.col("full"), F.col("kept")).alias("reduction"),
    )


def prefix_stability(messages: DataFrame, cfg: PruneConfig) -> DataFrame:
    """How often a request's pruned context is not a prefix of the next one (a cache miss).

    A row leaves the context at the first boundary beyond its cut-off age. The transition to the first
    request at or past that boundary is invalidated if the earlier request already held the row. So
    each row makes one event, matched with the next request by a window over positions.
    """
    quantum = max(cfg.quantum, 1)
    stable = F.col("pos") < max(cfg.stable_prefix, 0)
    cut = F.when(stable, F.lit(None)).otherwise(cutoff_of(F.col("signal"), cfg))
    rows = messages.select(*KEYS, "pos", "role", cut.alias("cut"))
    layout = Layout(KEYS, "pos", cfg.block_rows)
    users = layout.split(rows.filter(F.col("role").eqNullSafe("user")))
    users = layout.carry(users, last={"_earlier": F.col("pos")}, sums={"_no": F.lit(1)})
    requests = users.select(
        *KEYS,
        "pos",
        F.lit(None).cast("bigint").alias("row_pos"),
        F.struct(
            layout.row_number(F.col("_no")).alias("no"),
            layout.running_last(F.col("pos"), F.col("_earlier"), inclusive=False).alias("earlier"),
        ).alias("request"),
    )
    leave_at = F.ceil((F.col("pos") + F.col("cut") + 2) / quantum).cast("bigint") * quantum
    events = rows.filter(F.col("cut").isNotNull()).select(
        *KEYS,
        leave_at.alias("pos"),
        F.col("pos").alias("row_pos"),
        F.lit(None).cast(requests.schema["request"].dataType).alias("request"),
    )
    both = layout.carry(
        layout.split(requests.unionByName(events)),
        first_after={"_request_after": F.col("request")},
        reuse=True,
    )
    upcoming = layout.following_first(F.col("request"), F.col("_request_after"), same_position=True)
    hits = (
        both.withColumn("_next", upcoming)
        .filter(F.col("row_pos").isNotNull() & (F.col("row_pos") < F.col("_next.earlier")))
        .select(*KEYS, F.col("_next.no").alias("no"))
        .distinct()
        .groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("invalidations"))
    )
    totals = users.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("requests"))
    return totals.join(hits, KEYS, "left").select(
        *KEYS, "requests", F.coalesce(F.col("invalidations"), F.lit(0)).alias("invalidations")
    )
