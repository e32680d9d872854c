"""Exact top-k search by inner product with a pivot table.

Vectors are integer, so distances to pivots are exact up to one rounding. For a query q, a vector x and any pivot p the triangle
inequality bounds their distance from below by |d(q, p) - d(x, p)|, and with the greatest of these bounds over all pivots
q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2 is bounded from above. Candidates are evaluated in the order of that bound until it falls
below the k-th best score found.

Equal vectors are one class: its k + 1 smallest ids are all that a result of k can hold, by the order of ties, and one search
serves all queries that share a vector. Classes lie in cells by their nearest pivot; a cell is cut into blocks of bounded size by
hash, and queries into blocks of their own cell. A query block first searches one block of its cell for a threshold, then visits
only cells whose bounds (lowest and highest distance to each pivot, greatest norm) reach it. The pivots and their bounds by cell
are `pivots` rows of `pivots` numbers, whatever the table.

A vector that is null, or holds a null, NaN, infinite or too large component (2^24 and more after scaling: scores could leave 64
bits), takes no part. Shorter vectors count as filled up with zeros. Repeated rows are rows of their own; a query leaves out one
row of its own id and vector. Null ids come last among ties and are no queries. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.lineage import cut

#: Components from here on leave a vector out.
LARGEST = float(1 << 24)


@dataclass(frozen=True)
class SearchConfig:
    """Hits per query, pivots, classes looked at to choose them, and rows of a block of candidates and of queries."""

    k: int = 5
    pivots: int = 64
    sample: int = 4096
    block_rows: int = 4096
    query_rows: int = 512
    step: int = 256

    def __post_init__(self) -> None:
        if min(self.k, self.pivots, self.sample, self.block_rows, self.query_rows, self.step) < 1:
            raise ValueError("all parameters are 1 at least")


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component as integers; null where the vector takes no part."""
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    fit = F.forall(scaled, lambda x: F.coalesce((x > -LARGEST) & (x < LARGEST), F.lit(False)))
    return F.when(fit, F.transform(scaled, lambda x: F.floor(x).cast("int")))


def classes(vectors: DataFrame, is_query: Column, keep: int, id_col: str, vector_col: str) -> DataFrame:
    """One row per distinct `vector`: its `keep` smallest `ids`, and whether it has a query (`asked`)."""
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    rows = rows.filter("vector IS NOT NULL").withColumn("key", F.sha2(F.array_join("vector", ","), 256))
    # a limit by group is taken in every task before the shuffle, so a common vector sends a few rows from each
    order = Window.partitionBy("key").orderBy(F.asc_nulls_last("id"))
    least = rows.select("key", "vector", "id").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)
    least = least.groupBy("key").agg(F.first("vector").alias("vector"), F.transform(F.array_sort(F.collect_list(F.struct("n", "id"))), lambda x: x["id"]).alias("ids"))
    return least.join(rows.groupBy("key").agg(F.max("asked").alias("asked")), "key")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    out = np.zeros((len(column), width), np.float64)
    bounds, flat = column.offsets.to_numpy(), column.values.to_numpy()
    size = np.diff(bounds)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = flat[bounds[0] : bounds[-1]]
    return out


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows; squares are whole numbers below 2^53 for the components allowed, up to 32 of the largest."""
    square = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0.0))


def chosen_pivots(found: DataFrame, cfg: SearchConfig, width: int) -> np.ndarray:
    """Pivots far from each other among `sample` classes taken by hash."""
    sample = found.select("vector", "key").orderBy("key").limit(cfg.sample).select("vector").toArrow()
    if not len(sample):
        return np.zeros((1, width))
    rows = _matrix(sample["vector"].combine_chunks(), width)
    taken, far = [0], _distances(rows, rows[:1])[:, 0]
    while len(taken) < cfg.pivots and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, _distances(rows, rows[taken[-1:]])[:, 0])
    return rows[taken]


def slack(x: np.ndarray | float) -> np.ndarray | float:
    """Room for the roundings of a bound of this size."""
    return 1.0 + 1e-9 * np.abs(x)


def search_block(q: np.ndarray, q_table: np.ndarray, floor: np.ndarray, x: np.ndarray, x_table: np.ndarray, ids: list, keep: int, step: int) -> list[list[tuple[int, object]]]:
    """For each query the (score, id) pairs of a block that may be among the best `keep`, highest first, none below `floor`.

    `ids` has the ids of each class; scores are computed in 64-bit integers.
    """
    x_norm, q_norm = (x * x).sum(1), (q * q).sum(1)
    whole_x, whole_q = x.astype(np.int64), q.astype(np.int64)
    copies = np.array([len(i) for i in ids])
    out = []
    for i in range(len(q)):
        apart = np.abs(x_table - q_table[i]).max(1)
        bound = (q_norm[i] + x_norm - apart * apart) / 2.0
        bound += slack(q_norm[i] + x_norm)
        alive = np.flatnonzero(bound >= floor[i])
        order = alive[np.argsort(-bound[alive], kind="stable")]
        least, scores, places, held = float(floor[i]), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for at in range(0, len(order), step):
            part = order[at : at + step]
            if bound[part[0]] < least:
                break  # exact stop: no later candidate can reach the k-th best
            scores = np.concatenate([scores, whole_x[part] @ whole_q[i]])
            places = np.concatenate([places, part])
            best = np.argsort(-scores, kind="stable")
            held = np.cumsum(copies[places[best]])
            enough = int(np.searchsorted(held, keep))
            if enough < len(best):
                least = max(least, float(scores[best[enough]]))
                fit = scores >= least
                scores, places = scores[fit], places[fit]
        rows = [(int(s), id) for s, p in zip(scores, places) if s >= least for id in ids[p]]
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        out.append(rows[:keep])
    return out


#: A block: its rows as 32-bit integers and the pivot table as 64-bit floats, both row by row, with the keys and ids of its classes.
BLOCK = "cell int, no int, keys array<string>, ids array<array<long>>, rows binary, table binary"


def _packed(rows: DataFrame, block_rows: int, counts: DataFrame) -> DataFrame:
    """Classes of a cell by hash in blocks of about `block_rows`."""
    parts = F.ceil(F.col("count") / block_rows)
    spread = rows.join(F.broadcast(counts), "cell").withColumn("no", F.pmod(F.xxhash64("key"), parts).cast("int"))
    # keys of a block number are hashed, so each block stays near its size, however large its cell
    gathered = spread.groupBy("cell", "no").agg(F.collect_list(F.struct("key", "vector", "ids")).alias("of"))
    return gathered.select("cell", "no", F.col("of.key").alias("keys"), F.col("of.vector").alias("rows"), F.col("of.ids").alias("ids"))


def nearest(vectors: DataFrame, is_query: Column, cfg: SearchConfig = SearchConfig(), id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The `k` rows of the highest inner product for every row that `is_query` names: query_id, rank, id, score.

    `vector_col` holds arrays of integers as `quantised` gives them; ids are whole numbers. Ties go to the smaller id.
    """
    spark, keep = vectors.sparkSession, cfg.k + 1
    found = cut(classes(vectors, is_query, keep, id_col, vector_col))
    width = found.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    pivots = spark.sparkContext.broadcast(chosen_pivots(found, cfg, width))  # pivots x width numbers

    @F.arrow_udf("int")
    def cell_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(_distances(_matrix(batch, width), pivots.value).argmin(1), pa.int32()) if len(batch) else pa.array([], pa.int32())

    placed = cut(found.withColumn("cell", cell_of("vector")))
    sizes = placed.groupBy("cell").agg(F.count("*").alias("count"), F.count_if("asked").alias("asked"))
    sizes = cut(sizes)  # a row per pivot at most

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tables = [], []
            for vectors in batch.column("rows"):
                x = _matrix(vectors.values, width)
                rows.append(x.astype(np.int32).tobytes())
                tables.append(_distances(x, pivots.value).tobytes())
            kept = [batch.column(c) for c in ("cell", "no", "keys", "ids")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(rows, pa.binary()), pa.array(tables, pa.binary())], ["cell", "no", "keys", "ids", "rows", "table"])

    blocks = cut(_packed(placed, cfg.block_rows, sizes.select("cell", "count")).mapInArrow(tabled, BLOCK))
    asked = cut(_packed(placed.filter("asked"), cfg.query_rows, sizes.select("cell", F.col("asked").alias("count"))).mapInArrow(tabled, BLOCK))

    def unpacked(rows: pa.Scalar, table: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(rows.as_buffer(), np.int32).reshape(-1, width).astype(np.float64) if width else np.zeros((1, 0))
        return x, np.frombuffer(table.as_buffer(), np.float64).reshape(len(x), -1)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lowest and highest distance to each pivot and greatest norm of each cell of a task."""
        m = len(pivots.value)
        low, high, norm = np.full((m, m), np.inf), np.full((m, m), -np.inf), np.full(m, -np.inf)
        for batch in batches:
            for cell, *binary in zip(batch.column("cell").to_pylist(), batch.column("rows"), batch.column("table")):
                x, d = unpacked(*binary)
                low[cell], high[cell] = np.minimum(low[cell], d.min(0)), np.maximum(high[cell], d.max(0))
                norm[cell] = max(norm[cell], (x * x).sum(1).max())
        held = np.flatnonzero(norm >= 0)
        cells, at = np.repeat(held, m).astype(np.int32), np.tile(np.arange(m, dtype=np.int32), len(held))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cells, at, low[held].ravel(), high[held].ravel(), np.repeat(norm[held], m))], ["cell", "pivot", "low", "high", "norm"])

    told = blocks.select("cell", "rows", "table").mapInArrow(bounds, "cell int, pivot int, low double, high double, norm double")
    told = told.groupBy("cell", "pivot").agg(F.min("low"), F.max("high"), F.max("norm")).collect()  # pivots x pivots rows at most
    m = len(pivots.value)
    low, high, norm = np.full((m, m), np.inf), np.full((m, m), np.inf), np.full(m, -np.inf)
    for cell, pivot, a, b, n in told:
        low[cell, pivot], high[cell, pivot], norm[cell] = a, b, n
    ranges = spark.sparkContext.broadcast((low, high, norm))
    number = {r["cell"]: -(-r["count"] // cfg.block_rows) for r in sizes.collect()}
    counts = spark.createDataFrame(list(number.items()) or [(0, 0)], "cell int, blocks int")

    def thresholds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Query blocks with the k-th best score of one block, and the cells that can hold better ones."""
        low, high, norm = ranges.value
        for batch in batches:
            floors, visits = [], []
            for q_rows, q_of, rows, of, ids in zip(*[batch.column(c) for c in ("q_rows", "q_table", "rows", "table", "ids")]):
                (q, q_table), (x, x_table), ids = unpacked(q_rows, q_of), unpacked(rows, of), ids.as_py()
                best = search_block(q, q_table, np.full(len(q), -np.inf), x, x_table, ids, keep, cfg.step)
                floor = np.array([rows[-1][0] if len(rows) == keep else -np.inf for rows in best])
                q_norm, reach = (q * q).sum(1), np.zeros((len(q), len(norm)), bool)
                for cell in np.flatnonzero(norm >= 0):
                    apart = np.maximum(0.0, np.maximum(low[cell] - q_table, q_table - high[cell])).max(1)
                    bound = (q_norm + norm[cell] - apart * apart) / 2.0 + slack(q_norm + norm[cell])
                    reach[:, cell] = bound >= floor
                floors.append(floor.tolist())
                visits.append(np.flatnonzero(reach.any(0)).tolist())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("q_keys", "q_rows", "q_table")], pa.array(floors, pa.list_(pa.float64())), pa.array(visits, pa.list_(pa.int32()))],
                ["q_keys", "q_rows", "q_table", "floors", "visits"],
            )

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, scores, ids = [], [], []
            for keys, q_rows, q_of, floor, rows, of, own in zip(*[batch.column(c) for c in ("q_keys", "q_rows", "q_table", "floors", "rows", "table", "ids")]):
                (q, q_table), (x, x_table) = unpacked(q_rows, q_of), unpacked(rows, of)
                for key, rows in zip(keys.as_py(), search_block(q, q_table, np.array(floor.as_py()), x, x_table, own.as_py(), keep, cfg.step)):
                    queries += [key] * len(rows)
                    scores += [s for s, _ in rows]
                    ids += [i for _, i in rows]
            yield pa.RecordBatch.from_arrays([pa.array(queries, pa.string()), pa.array(scores, pa.int64()), pa.array(ids, pa.int64())], ["key", "score", "id"])

    q = asked.select(F.col("cell").alias("q_cell"), *[F.col(c).alias(f"q_{c}") for c in ("keys", "rows", "table")])
    first = q.join(blocks.filter("no = 0"), F.col("q_cell") == F.col("cell"))
    with_floor = cut(first.mapInArrow(thresholds, "q_keys array<string>, q_rows binary, q_table binary, floors array<double>, visits array<int>"))
    visits = with_floor.withColumn("cell", F.explode("visits")).join(F.broadcast(counts), "cell").filter("blocks > 0")
    visits = visits.withColumn("no", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("visits", "blocks")
    # the work lies in the pairs of blocks, not in their bytes: as many tasks as there are blocks, up to 2^12
    tasks = min(1 << 12, max(1, sum(number.values())))
    met = visits.repartition(tasks, "cell", "no").join(blocks.select("cell", "no", "ids", "rows", "table").repartition(tasks, "cell", "no"), ["cell", "no"])
    hits = met.mapInArrow(searched, "key string, score long, id long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = hits.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= keep)
    best = cut(best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("best")))

    # queries of one vector may be many: they meet their result in parts by hash, a part for every 2^16 queries of the table
    vector = F.col(f"`{vector_col}`")
    norm = F.aggregate(vector, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    own = vectors.filter(F.coalesce(is_query, F.lit(False)) & vector.isNotNull()).select(
        F.col(f"`{id_col}`").alias("query_id"), F.sha2(F.array_join(vector, ","), 256).alias("key"), norm.alias("norm")
    )
    total = own.count()
    salt = F.pmod(F.xxhash64("query_id"), F.lit(1 + total // (1 << 16))).cast("int")
    own = own.withColumn("salt", salt)
    spread = own.select("key", "salt").distinct().join(best, "key")
    mine = F.array_position(F.transform("best", lambda b: F.coalesce((b["id"] == F.col("query_id")) & (b["score"] == F.col("norm")), F.lit(False))), True)
    others = F.filter("best", lambda b, i: (i + 1 != mine))
    hit = own.join(spread, ["key", "salt"]).select("query_id", F.posexplode(F.slice(others, 1, cfg.k)).alias("at", "hit"))
    return hit.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("id"), F.col("hit.score").alias("score"))
