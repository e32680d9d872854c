"""Exact ranked lexical search over impact vectors in buckets by length.

A document is a vector over the terms of the queries: sqrt(w) times the impact of each, where w is the term's weight; a query has
sqrt(w) times how often it has the term. Their inner product is the score. Vectors are ordered by length and read in buckets of
bounded size, longest first:

* Cauchy-Schwarz drops a bucket, and the rows at its end, whose length times the query's cannot reach the query's threshold;
* inside, the query's heaviest coordinates are summed exactly, and what is left of both lengths bounds the rest of the product;
* rows that still can reach the threshold are scored exactly in 64-bit integers, and raise the threshold.

The first threshold is the k-th best score among the longest vectors. It only ever cuts rows that are no result, so ties and
repeated rows are kept as they are. Queries are taken in blocks of bounded size, one pass over the term counts for each; the
texts of documents are read once per block.

A null text has no terms, nor has an empty one; such documents are in no count and no result. Null ids rank last among ties.
Rows that repeat are documents of their own. Without documents or queries the result is empty.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.pivots import slack
from palimpsest.operators.lineage import checkpoint_root, cut

#: Bytes of terms: letters and digits of ASCII and every byte of other characters. A-Z become small, other bytes spaces.
_TERM = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


@dataclass(frozen=True)
class LexicalConfig:
    """Hits per query; rows of a bucket; longest vectors scored for the first threshold; heavy coordinates summed exactly; queries
    and terms with repeats of one block of queries (a longer query is a block of its own)."""

    k: int = 20
    bucket_rows: int = 4096
    seeds: int = 16384
    focus: int = 8
    block_queries: int = 1024
    block_terms: int = 1 << 18


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_TERM).split()


def weights(n: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) in doubles."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Per document with a term: `id`, `n` (all its terms), and `terms` and `times` of those in the vocabulary, by term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("struct<n: bigint, terms: array<int>, times: array<int>>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for batch in batches:
            sizes, bounds, terms, times = [], [0], [], []
            for text in batch:
                words = terms_of(text.as_py() or "")
                found = sorted((known[w], c) for w, c in Counter(words).items() if w in known)
                sizes.append(len(words))
                terms += [t for t, _ in found]
                times += [c for _, c in found]
                bounds.append(len(terms))
            ends = pa.array(bounds, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(values, pa.int32())) for values in (terms, times)]
            yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), *lists], ["n", "terms", "times"])

    told = docs.select(F.col(f"`{id_col}`").alias("id"), count(F.col(f"`{text_col}`")).alias("c"))
    return told.select("id", "c.*").filter("n > 0")


class Queries:
    """Queries of a block as sparse vectors over its vocabulary."""

    def __init__(self, terms: list[np.ndarray], times: list[np.ndarray], weight: np.ndarray):
        self.terms, self.weight = terms, weight
        self.times = times
        self.vectors = [np.sqrt(weight[t].astype(np.float64)) * c for t, c in zip(terms, times)]
        self.lengths = np.array([math.sqrt(float((v * v).sum())) for v in self.vectors])


class Bucket:
    """Rows of impact vectors with their columns by term."""

    def __init__(self, batch: pa.RecordBatch, root: np.ndarray):
        lists = batch.column("terms")
        self.bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        self.terms = lists.flatten().to_numpy()
        self.impacts = batch.column("impacts").flatten().to_numpy()
        self.lengths = batch.column("length").to_numpy()
        self.ids = batch.column("id")
        self.row = np.repeat(np.arange(len(self.lengths)), np.diff(self.bounds))
        order = np.argsort(self.terms, kind="stable")
        self.sorted_terms, self.rows_by_term = self.terms[order], self.row[order]
        self.values_by_term = root[self.sorted_terms] * self.impacts[order]

    def column(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(self.sorted_terms, (term, term + 1))
        return self.rows_by_term[a:b], self.values_by_term[a:b]

    def reaching(self, terms: np.ndarray, vector: np.ndarray, length: float, least: float, focus: int) -> np.ndarray:
        """Rows whose bound reaches `least`."""
        rows = np.flatnonzero(self.lengths * length + slack(self.lengths * length) >= least)
        if not len(rows):
            return rows
        heavy = np.argsort(-vector, kind="stable")[:focus]
        exact, square = np.zeros(len(self.lengths)), np.zeros(len(self.lengths))
        for i in heavy.tolist():
            at, values = self.column(int(terms[i]))
            exact[at] += vector[i] * values
            square[at] += values * values
        rest = math.sqrt(max(0.0, length * length - float((vector[heavy] ** 2).sum())))
        bound = exact + rest * np.sqrt(np.maximum(0.0, self.lengths * self.lengths * (1 + 1e-12) - square))
        return rows[bound[rows] + slack(bound[rows]) >= least]

    def scores(self, rows: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Exact scores of rows; `gain` has weight times repeats of the query by term."""
        size = self.bounds[rows + 1] - self.bounds[rows]
        start = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(self.bounds[rows] - start, size)
        return np.add.reduceat(gain[self.terms[at]] * self.impacts[at], start)  # every row has a term


def _best(scores: np.ndarray, ids: list, k: int) -> list[tuple[int, object]]:
    rows = sorted(zip(scores.tolist(), ids), key=lambda r: (-r[0], r[1] is None, r[1] or 0))
    return rows[:k]


def ranked_block(vectors: DataFrame, queries: Queries, floors: np.ndarray, cfg: LexicalConfig) -> DataFrame:
    """The best rows of each task by query (`query`, `id`, `score`), at least `floors`; `vectors` come longest first."""
    shared = vectors.sparkSession.sparkContext.broadcast((queries, floors))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, floors = shared.value
        root, best = np.sqrt(queries.weight.astype(np.float64)), [[] for _ in floors]
        least, gain = np.maximum(floors, 1.0), np.zeros(len(queries.weight), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, cfg.bucket_rows):
                bucket = Bucket(batch.slice(at, cfg.bucket_rows), root)
                longest = float(bucket.lengths.max())
                for q in np.flatnonzero(queries.lengths * longest + slack(queries.lengths * longest) >= least).tolist():
                    terms, vector = queries.terms[q], queries.vectors[q]
                    rows = bucket.reaching(terms, vector, float(queries.lengths[q]), float(least[q]), cfg.focus)
                    if not len(rows):
                        continue
                    gain[terms] = queries.weight[terms] * queries.times[q]
                    scores = bucket.scores(rows, gain)
                    gain[terms] = 0
                    fit = np.flatnonzero(scores >= least[q])
                    if len(fit) > cfg.k:  # the k-th best of the bucket; ties stay
                        fit = fit[scores[fit] >= np.partition(scores[fit], -cfg.k)[-cfg.k]]
                    if len(fit):
                        held = best[q] + list(zip(scores[fit].tolist(), bucket.ids.take(pa.array(rows[fit])).to_pylist()))
                        best[q] = _best(np.array([s for s, _ in held]), [i for _, i in held], cfg.k)
                        if len(best[q]) == cfg.k:
                            least[q] = max(least[q], best[q][-1][0])
        found = [(q, i, s) for q, rows in enumerate(best) for s, i in rows]
        columns = list(zip(*found)) if found else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))], ["query", "id", "score"])

    return vectors.select("id", "terms", "impacts", "length").mapInArrow(search, "query int, id long, score long")


def _top(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _search(docs: DataFrame, items: list[Counter], cfg: LexicalConfig, id_col: str, text_col: str) -> DataFrame:
    """Hits of one block of queries by their number."""
    spark = docs.sparkSession
    folder = f"{checkpoint_root(spark)}/impacts-{uuid4().hex}"
    vocabulary = {t: i for i, t in enumerate(sorted({t for item in items for t in item}))}
    _counted(docs, vocabulary, id_col, text_col).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, c in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*")).collect():  # a row per term of the block
        df[term] = c
    weight = np.where(df > 0, weights(n, df), 0)  # a term that no document has adds nothing to a score, nor to a bound
    root = spark.sparkContext.broadcast(np.sqrt(weight.astype(np.float64)))

    @F.arrow_udf("double")
    def length(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for terms, impacts in batches:
            values = root.value[terms.flatten().to_numpy()] * impacts.flatten().to_numpy()
            sums = np.append(0.0, np.cumsum(values * values))
            bounds = terms.offsets.to_numpy() - (terms.offsets[0].as_py() if len(terms) else 0)
            # cumulative sums round, so lengths are taken a little longer than they are: bounds stay bounds
            yield pa.array(np.sqrt(np.maximum(0.0, np.diff(sums[bounds])) + 1e-9 * sums[bounds[1:]]))

    m = F.lit(75) + F.expr(f"(25 * n * {n}L) div {total}L")
    impacts = F.expr("transform(times, tf -> (1000000000L * tf) div (1000L * tf + 12L * m))")
    vectors = counts.filter("size(terms) > 0").withColumn("m", m).withColumn("impacts", impacts).withColumn("length", length("terms", "impacts"))
    vectors.select("id", "terms", "impacts", "length").write.parquet(f"{folder}/vectors")
    vectors = spark.read.parquet(f"{folder}/vectors")
    queries = Queries(
        [np.array(sorted(vocabulary[t] for t in item), np.int64) for item in items],
        [np.array([c for _, c in sorted((vocabulary[t], c) for t, c in item.items())], np.int64) for item in items],
        weight,
    )
    share = max(0.0, 1.0 - cfg.seeds / max(1, n))
    longest = vectors.approxQuantile("length", [share], 0.001)
    first = ranked_block(vectors.filter(F.col("length") >= (longest[0] if longest else 0.0)), queries, np.ones(len(items)), cfg)
    floors = np.ones(len(items))
    for q, score in _top(first, cfg.k).filter(F.col("rank") == cfg.k).select("query", "score").collect():  # a row per query of the block
        floors[q] = score
    ordered = vectors.repartitionByRange(F.desc("length"), "id").sortWithinPartitions(F.desc("length"))
    return _top(ranked_block(ordered, queries, floors, cfg), cfg.k)


def _blocks(items: DataFrame, cfg: LexicalConfig) -> Iterator[list]:
    """Queries in blocks, a block at a time on the driver."""
    held: list[tuple[object, Counter]] = []
    size = 0
    for row in items.toLocalIterator():
        found = Counter(terms_of(row["text"] or ""))
        if held and (len(held) >= cfg.block_queries or size + len(found) > cfg.block_terms):
            yield held
            held, size = [], 0
        held.append((row["item"], found))
        size += len(found)
    if held:
        yield held


def ranked(docs: DataFrame, queries: DataFrame, cfg: LexicalConfig = LexicalConfig(), id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id") -> DataFrame:
    """The `k` best documents of each row of `queries` (its id, rank, the document's id, score), none with score 0."""
    spark = docs.sparkSession
    asked = queries.select(F.col(f"`{query_col}`").alias("item"), F.col(f"`{text_col}`").alias("text"))
    kind = asked.schema["item"].dataType.simpleString()
    out = None
    for block in _blocks(asked, cfg):
        hits = _search(docs, [terms for _, terms in block], cfg, id_col, text_col)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], f"query int, item {kind}")
        told = cut(hits.join(F.broadcast(names), "query").select(F.col("item").alias(query_col), "rank", F.col("id").alias(id_col), "score"))
        out = told if out is None else out.unionByName(told)
    return out if out is not None else spark.createDataFrame([], f"`{query_col}` {kind}, rank int, `{id_col}` long, score long")
