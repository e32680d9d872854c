from __future__ import annotations

import random

from pyspark.sql import functions as F

from palimpsest.llm import pivots
from palimpsest.llm.pivots import SearchConfig


def brute(rows, k, asked):
    width = max((len(v) for _, v in rows), default=0)
    rows = [(i, list(v) + [0] * (width - len(v))) for i, v in rows]
    out = []
    for at, (q, v) in enumerate(rows):
        if q is None or not asked(q):
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), i is None, i or 0, i) for j, (i, w) in enumerate(rows) if j != at]
        out += [(q, n + 1, i, -s) for n, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def found(spark, rows, k=5, **of):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, vector array<int>, key string, id int")
    got = pivots.nearest(df, F.col("vec_id") % 5 == 0, SearchConfig(k=k, **of), id_col="vec_id", vector_col="vector")
    return sorted([tuple(r) for r in got.select("query_id", "rank", F.col("id"), "score").collect()], key=str)


def test_against_all_pairs(spark):
    rng = random.Random(1)
    centres = [[rng.randint(-80, 80) for _ in range(12)] for _ in range(6)]
    rows = [(i, [c + rng.randint(-9, 9) for c in rng.choice(centres)]) for i in range(300)]
    assert found(spark, rows, pivots=8, block_rows=40, query_rows=7, step=16) == brute(rows, 5, lambda q: q % 5 == 0)


def test_copies_ties_nulls_and_short_vectors(spark):
    rng = random.Random(2)
    same = [3, -1, 2, 0]
    rows = [(i, same if i % 3 == 0 else [rng.randint(-2, 2) for _ in range(rng.randint(0, 4))]) for i in range(90)]
    rows += [(None, same), (None, [1, 1, 1, 1]), (5, rows[5][1]), (5, rows[5][1]), (10, [9, 9])]
    for k in (1, 4):
        assert found(spark, rows, k=k, pivots=4, block_rows=10, query_rows=3, step=2) == brute(rows, k, lambda q: q % 5 == 0)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(5, [1, 2])]) == []
    assert found(spark, [(5, [1, 2]), (6, [0, 0])]) == [(5, 1, 6, 0)]
    assert found(spark, [(5, []), (6, [])]) == [(5, 1, 6, 0)]


def test_quantised(spark):
    bad = [None, [1.0, None], [float("nan")], [float("inf")], [1e12]]
    rows = [(0, [0.5, -0.001, 0.0]), *enumerate(bad, 1)]
    df = spark.createDataFrame(rows, "i int, v array<float>").withColumn("q", pivots.quantised(F.col("v"), 256))
    got = {r["i"]: r["q"] for r in df.collect()}
    assert got == {0: [128, -1, 0]} | {i: None for i in range(1, 6)}


def test_elimination_works(spark):
    """On clustered vectors most candidates are never evaluated, and the result is the same."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = (rng.integers(-400, 400, (20, 16))[rng.integers(0, 20, 2000)] + rng.integers(-3, 4, (2000, 16))).astype(float)
    p = x[rng.choice(2000, 30, replace=False)]
    tables = [pivots._distances(y, p) for y in (x[:50], x)]
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray) and key.dtype == np.int64 and self.ndim == 2:
                seen.append(len(key))
            return super().__getitem__(key)

        def astype(self, *a, **k):
            return np.asarray(self).astype(*a, **k).view(Counted)

    got = pivots.search_block(x[:50], tables[0], np.full(50, -np.inf), x.view(Counted), tables[1], [[i] for i in range(2000)], 6, 16)
    assert sum(seen) < 50 * 2000 * 0.25
    for i, rows in enumerate(got):
        scores = sorted(((-int(s), j) for j, s in enumerate(x @ x[i])))[:6]
        assert rows == [(-s, j) for s, j in scores]
