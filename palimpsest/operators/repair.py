"""Deletion-only protocol repair of pruned sessions.

Rules: no rows before the first user row; a row with tool results stays only if the row kept before
it is an assistant row that used all those tools; an assistant row that used tools stays only if the
next kept row answers one of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.config import BLOCK_ROWS
from palimpsest.operators.lineage import cut
from palimpsest.operators.sequence import Layout

KEYS = ["session_id"]


def repair(messages: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Protocol-valid subset of the rows (columns as from `units.flatten_messages`)."""
    columns = messages.columns
    layout = Layout(KEYS, "pos", block_rows)
    rows = layout.split(messages)
    # A user row that only carries results has nothing before it to answer, so it cannot open either.
    user_at = F.when(F.col("role").eqNullSafe("user") & ~F.col("has_result"), F.col("pos"))
    rows = layout.carry(rows, first={"_first_user": user_at}).filter(F.col("pos") >= F.col("_first_user"))
    return _answered_uses(_paired_results(rows, layout), layout).select(*columns)


def _fits(result_ids: Column, giver: Column) -> Column:
    return (giver["role"] == "assistant") & (F.size(F.array_except(result_ids, giver["use_ids"])) == 0)


def _paired_results(rows: DataFrame, layout: Layout) -> DataFrame:
    """Second rule. Rows without results always stay, so they delimit runs of result rows.

    In a run, the first row that fits the delimiter before it stays. Unless that row is itself an
    assistant row it cannot back the rest of the run, which falls. Only runs where an assistant row
    carries results need more.
    """
    giver = F.when(
        ~F.col("has_result"),
        F.struct(F.col("pos").alias("at"), F.col("role").alias("role"), F.col("use_ids").alias("use_ids")),
    )
    seen = layout.carry(rows.withColumn("_giver", giver), last={"_giver_before": F.col("_giver")}, reuse=True)
    seen = seen.withColumn("_run", layout.running_last(F.col("_giver"), F.col("_giver_before")))
    fits = F.col("has_result") & F.coalesce(_fits(F.col("result_ids"), F.col("_run")), F.lit(False))
    seen = seen.withColumn("_fits", fits)

    results = seen.filter("has_result").withColumn("_run_at", F.coalesce(F.col("_run.at"), F.lit(-1)))
    runs = results.groupBy(*KEYS, "_run_at").agg(
        F.min(F.when(F.col("_fits"), F.col("pos"))).alias("_first_fit"),
        F.bool_or(F.col("role").eqNullSafe("assistant")).alias("_chained"),
    )
    simple = results.join(runs, [*KEYS, "_run_at"]).select(
        *KEYS, "pos", "_run_at", "_chained", "role", "use_ids", "result_ids", "_run",
        (F.col("pos") == F.col("_first_fit")).alias("_ok"),
    )
    plain = simple.filter(~F.col("_chained") & F.col("_ok")).select(*KEYS, "pos")
    chained = cut(simple.filter("_chained"))
    stay = plain if chained.isEmpty() else plain.unionByName(_chained(chained, layout.block_rows))
    return (
        rows.filter(~F.col("has_result"))
        .unionByName(rows.filter("has_result").join(stay, [*KEYS, "pos"], "left_semi").select(rows.columns))
    )


def _chained(rows: DataFrame, block_rows: int) -> DataFrame:
    """Positions kept in runs where rows with results may back later ones.

    Whichever row is kept, the next one kept is the first later row of the run whose results it all used. So every row that could
    back others points to one successor, and the kept rows are those that pointers reach from the delimiter: pointers double in
    length until none is left, a number of rounds that is the logarithm of the longest chain. Successors are looked up by set of
    results, among the distinct sets of a run, and then by position.
    """
    run = [*KEYS, "_run_at"]
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    givers = rows.groupBy(*run).agg(F.first("_run").alias("_run")).filter("_run.role = 'assistant'")
    givers = givers.select(*run, F.col("_run_at").alias("node"), as_set(F.col("_run.use_ids")).alias("uses"))
    nodes = cut(givers.unionByName(rows.filter("role = 'assistant'").select(*run, F.col("pos").alias("node"), as_set(F.col("use_ids")).alias("uses"))))
    results = cut(rows.select(*run, "pos", as_set(F.col("result_ids")).alias("wants")))

    used, wanted = nodes.select(*run, "uses").distinct(), results.select(*run, "wants").distinct()
    by_first = used.withColumn("id", F.explode("uses")).join(wanted.filter("size(wants) > 0").withColumn("id", F.col("wants")[0]), [*run, "id"])
    some = by_first.filter(F.size(F.array_except("wants", "uses")) == 0).select(*run, "uses", "wants")
    fits = some.unionByName(used.join(wanted.filter("size(wants) = 0"), run))

    asked = nodes.join(fits, [*run, "uses"]).select(*run, "wants", (2 * F.col("node") + 1).alias("at"), "node", F.lit(None).cast("bigint").alias("pos"))
    given = results.select(*run, "wants", (2 * F.col("pos")).alias("at"), F.lit(None).cast("bigint").alias("node"), "pos")
    layout = Layout([*run, "wants"], "at", block_rows)
    placed = layout.carry(layout.split(asked.unionByName(given)), first_after={"_after": F.col("pos")}, reuse=True)
    placed = placed.withColumn("next", layout.following_first(F.col("pos"), F.col("_after"))).filter("node IS NOT NULL AND next IS NOT NULL")
    jumps = cut(placed.groupBy(*run, "node").agg(F.min("next").alias("next")))

    reached = givers.select(*run, "node")
    while True:
        hops = cut(reached.join(jumps, [*run, "node"]).select(*run, F.col("next").alias("node")))
        if hops.isEmpty():
            return reached.filter("node <> _run_at").select(*KEYS, F.col("node").alias("pos"))
        reached = cut(reached.unionByName(hops))
        further = jumps.select(*run, F.col("node").alias("next"), F.col("next").alias("far"))
        jumps = cut(jumps.join(further, [*run, "next"]).select(*run, "node", F.col("far").alias("next")))


def _answered_uses(rows: DataFrame, layout: Layout) -> DataFrame:
    """Third rule, against the neighbour that the second rule left."""
    seen = layout.carry(
        rows.drop("_first_user"), first_after={"_answer_after": F.col("result_ids")}, reuse=True
    )
    answer = layout.following_first(F.col("result_ids"), F.col("_answer_after"))
    dangling = (
        F.col("role").eqNullSafe("assistant")
        & (F.size("use_ids") > 0)
        & ~F.coalesce(F.arrays_overlap(F.col("use_ids"), answer), F.lit(False))
    )
    return layout.merge(seen.withColumn("_dangling", dangling).filter(~F.col("_dangling")))
