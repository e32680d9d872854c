"""Ordered work inside sessions, also inside sessions that no single task could hold.

Plain windows by session are the cheapest plan as long as every session fits into a task. Whether they
do is counted (`largest_group`), not assumed. Where a session may own a third of all rows, a `Layout`
with block_rows > 0 cuts each session at every block_rows positions, runs the windows per
(session, block), and brings in what a block needs from its neighbours in one of two ways:

* carried values: per-block aggregates (map-side combined), scanned by a window over *blocks*, one row
  per 65,536 positions, then joined back on (session, block);
* halo rows: for frames of bounded length, rows near a border are also sent to the next block.

Both layouts give the same rows. The operators are written once, against `Layout`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import BLOCK_ROWS
from palimpsest.operators.lineage import cut

BLOCK = "_block"


def largest_group(df: DataFrame, *keys: str | Column) -> int:
    """Rows of the largest key. A counting job over the key columns alone, combined on the map side."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_in"))
    return int(sizes.agg(F.max("rows_in")).first()[0] or 0)


def fitting_block_rows(df: DataFrame, *keys: str | Column, block_rows: int = BLOCK_ROWS) -> int:
    """0 (whole sessions per task) when the largest session fits into one block, else block_rows."""
    return 0 if largest_group(df, *keys) <= block_rows else block_rows


class Layout:
    """How the rows of a session are spread over tasks. block_rows 0: one task per session."""

    def __init__(self, keys: Sequence[str], pos: str = "pos", block_rows: int = BLOCK_ROWS) -> None:
        self.keys = list(keys)
        self.pos = pos
        self.block_rows = int(block_rows)
        self.blocked = self.block_rows > 0
        self.cells = [*self.keys, BLOCK] if self.blocked else self.keys

    def split(self, df: DataFrame) -> DataFrame:
        """Add the block column, if there are blocks."""
        if not self.blocked:
            return df
        return df.withColumn(BLOCK, F.floor(F.col(self.pos) / self.block_rows).cast("bigint"))

    def merge(self, df: DataFrame) -> DataFrame:
        return df.drop(BLOCK)

    def window(self):
        """Rows of one block (or session) in order."""
        return Window.partitionBy(*self.cells).orderBy(self.pos)

    def carry(
        self,
        df: DataFrame,
        *,
        sums: Mapping[str, Column] | None = None,
        totals: Mapping[str, Column] | None = None,
        last: Mapping[str, Column] | None = None,
        first_after: Mapping[str, Column] | None = None,
        first: Mapping[str, Column] | None = None,
        final: Mapping[str, Column] | None = None,
        reuse: bool = False,
    ) -> DataFrame:
        """Add to every row what its block must know about the rest of the session.

        sums: total over all earlier blocks; totals: over the whole session; last: latest non-null value
        in earlier blocks; first_after: next non-null value in later blocks; first / final: smallest /
        largest value in the whole session. With one task per session, only the whole-session values
        need computing, as windows. With blocks the input is read twice; `reuse` stores it first, for
        inputs that are themselves costly (they would otherwise be recomputed at every level).
        """
        sums, totals, last = dict(sums or {}), dict(totals or {}), dict(last or {})
        first_after, first, final = dict(first_after or {}), dict(first or {}), dict(final or {})
        if not self.blocked:
            return self._whole(df, sums, totals, last, first_after, first, final)
        if reuse:
            df = cut(df)
        order = F.col(self.pos)
        aggs = [F.sum(e).alias(f"_s_{n}") for n, e in sums.items()]
        aggs += [F.sum(e).alias(f"_t_{n}") for n, e in totals.items()]
        aggs += [F.max_by(e, F.when(e.isNotNull(), order)).alias(f"_l_{n}") for n, e in last.items()]
        aggs += [F.min_by(e, F.when(e.isNotNull(), order)).alias(f"_f_{n}") for n, e in first_after.items()]
        aggs += [F.min(e).alias(f"_i_{n}") for n, e in first.items()]
        aggs += [F.max(e).alias(f"_x_{n}") for n, e in final.items()]
        everything = Window.partitionBy(*self.keys)
        ordered = everything.orderBy(BLOCK)
        before = ordered.rowsBetween(Window.unboundedPreceding, -1)
        after = everything.orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
        columns = [F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(n) for n in sums]
        columns += [F.coalesce(F.sum(f"_t_{n}").over(everything), F.lit(0)).alias(n) for n in totals]
        columns += [F.last(f"_l_{n}", ignorenulls=True).over(before).alias(n) for n in last]
        columns += [F.last(f"_f_{n}", ignorenulls=True).over(after).alias(n) for n in first_after]
        columns += [F.min(f"_i_{n}").over(everything).alias(n) for n in first]
        columns += [F.max(f"_x_{n}").over(everything).alias(n) for n in final]
        blocks = df.groupBy(*self.cells).agg(*aggs).select(*self.cells, *columns)
        return df.join(blocks, self.cells)

    def _whole(self, df, sums, totals, last, first_after, first, final) -> DataFrame:
        session = Window.partitionBy(*self.keys)
        added: dict[str, Column] = {n: F.lit(0).cast("bigint") for n in sums}
        added |= {n: F.coalesce(F.sum(e).over(session), F.lit(0)) for n, e in totals.items()}
        added |= {n: F.when(F.lit(False), e) for n, e in (last | first_after).items()}
        added |= {n: F.min(e).over(session) for n, e in first.items()}
        added |= {n: F.max(e).over(session) for n, e in final.items()}
        return df.select("*", *[e.alias(n) for n, e in added.items()])

    def running_sum(self, value: Column, carried: Column, *, inclusive: bool = True) -> Column:
        """Sum over the session up to the row."""
        w = self.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return carried + F.coalesce(F.sum(value).over(w), F.lit(0))

    def running_last(self, value: Column, carried: Column, *, inclusive: bool = True) -> Column:
        """Latest non-null value up to the row."""
        w = self.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return F.coalesce(F.last(value, ignorenulls=True).over(w), carried)

    def following_first(self, value: Column, carried: Column, *, same_position: bool = False) -> Column:
        """Next non-null value after the row, or also at its position.

        Read backwards as a running value: a frame that reaches forward to the end of the partition is
        evaluated anew for every row, which is quadratic.
        """
        w = Window.partitionBy(*self.cells).orderBy(F.desc(self.pos))
        if same_position:
            w = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        else:
            w = w.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.last(value, ignorenulls=True).over(w), carried)

    def row_number(self, carried: Column) -> Column:
        """1-based number of the row, given the rows in earlier blocks."""
        return (carried + F.row_number().over(self.window())).cast("bigint")

    def with_halo(self, df: DataFrame, *, before: int = 0, after: int = 0) -> DataFrame:
        """Blocks that overlap: each also holds `before` rows ahead of it and `after` rows behind it.

        Foreign rows have `_halo = true`; drop them once the bounded frames are computed. The copies are
        (before + after) rows per block and need no shuffle of their own.
        """
        if not self.blocked:
            return df.withColumn("_halo", F.lit(False))
        p = F.col(self.pos)
        low = F.greatest(F.floor((p - after) / self.block_rows), F.lit(0)).cast("bigint")
        high = F.floor((p + before) / self.block_rows).cast("bigint")
        own = F.floor(p / self.block_rows).cast("bigint")
        spread = df.withColumn(BLOCK, F.explode(F.sequence(low, high)))
        return spread.withColumn("_halo", F.col(BLOCK) != own)


def dense_positions(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    fine: Mapping[str, Column],
    coarse: Column,
    *,
    whole: bool = False,
) -> DataFrame:
    """Number the rows of every session 0, 1, 2 ... in `order_by` order and add the session size `n`.

    `whole` numbers each session in one task. Otherwise `fine` names columns that coarsen the ordering
    (equal or increasing along it) into cells small enough for one task, such as (conversation, turn
    div 65536) or the hour of a timestamp, and `coarse` coarsens the cells once more. Only cell counts
    cross the session: a hot session is spread over its cells, and its rows are shuffled once, by cell.
    """
    if whole:
        w = Window.partitionBy(*keys)
        return df.select(
            "*",
            (F.row_number().over(w.orderBy(*order_by)) - 1).cast("bigint").alias("pos"),
            F.count(F.lit(1)).over(w).alias("n"),
        )
    names = [f"_fine_{n}" for n in fine]
    rows = df.select("*", *[e.alias(a) for a, e in zip(names, fine.values())], coarse.alias("_coarse"))
    cells = _cell_offsets(rows, keys, names, "_coarse")
    w = Window.partitionBy(*keys, *names).orderBy(*order_by)
    numbered = rows.join(cells, [*keys, *names]).withColumn(
        "pos", (F.col("_start") + F.row_number().over(w) - 1).cast("bigint")
    )
    return numbered.drop(*names, "_coarse", "_start")


def _cell_offsets(df: DataFrame, keys: Sequence[str], fine: Sequence[str], coarse: str) -> DataFrame:
    """Offset of each (session, fine cell) in its session, and the session size."""
    cells = df.groupBy(*keys, coarse, *fine).agg(F.count(F.lit(1)).alias("_rows"))
    session = Window.partitionBy(*keys)
    earlier = session.orderBy(coarse).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        cells.groupBy(*keys, coarse)
        .agg(F.sum("_rows").alias("_block_rows"))
        .select(
            *keys,
            coarse,
            F.coalesce(F.sum("_block_rows").over(earlier), F.lit(0)).alias("_block_start"),
            F.sum("_block_rows").over(session).alias("n"),
        )
    )
    inside = Window.partitionBy(*keys, coarse).orderBy(*fine).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_block_start") + F.coalesce(F.sum("_rows").over(inside), F.lit(0))
    return cells.join(blocks, [*keys, coarse]).select(*keys, *fine, start.alias("_start"), "n")


def ages(df: DataFrame, layout: Layout) -> DataFrame:
    """Session size and distance of each row from the newest row; every row counts."""
    rows = layout.carry(layout.split(df.drop("n")), totals={"n": F.lit(1)})
    return layout.merge(rows).withColumn("age", F.col("n") - 1 - F.col(layout.pos))


def number_rows(df: DataFrame, keys: Sequence[str], order: str, block_rows: int, name: str) -> DataFrame:
    """Dense numbers 0, 1, 2 ... for rows that have a unique, sparse integer order."""
    layout = Layout(keys, order, block_rows)
    counted = layout.carry(layout.split(df), sums={"_before": F.lit(1)})
    numbered = counted.withColumn("_no", layout.row_number(F.col("_before")) - 1)
    return layout.merge(numbered.drop("_before", name)).withColumnRenamed("_no", name)
