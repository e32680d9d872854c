from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from palimpsest.llm import impacts
from palimpsest.llm.impacts import LexicalConfig

from .helpers import documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]


def brute(docs, queries, k):
    rows = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    rows = [r for r in rows if r[2]]
    n, total = len(rows), sum(r[2] for r in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in queries:
        scores = []
        for i, c, size in rows:
            m = 100 - 25 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def found(spark, docs, queries, **of):
    asked = spark.createDataFrame([(i, t, "x", 1.5) for i, t in queries], "item_id long, text string, id string, length double")
    return sorted([tuple(r) for r in impacts.ranked(documents(spark, docs), asked, LexicalConfig(**of)).collect()], key=str)


def random_docs(n, seed):
    rng = random.Random(seed)
    words = [f"{rng.choice(['W', 'w', 'é', '日本', 'Straße'])}{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    seps = [" ", "  ", "\n", ", ", ". ", "-", "\x7f", "_"]
    return [(i, "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.choice([0, 3, 20, 60, 200])))) for i in range(n)]


@pytest.mark.parametrize("of", [{}, {"k": 3, "bucket_rows": 16, "seeds": 10, "focus": 2}, {"k": 7, "seeds": 1, "block_queries": 4, "block_terms": 60}])
def test_against_all_scores(spark, of):
    docs = random_docs(150, 4)
    queries = [(i, t[:300]) for i, t in random_docs(11, 6)] + [(100, docs[3][1]), (101, "nowhere"), (102, docs[5][1])]
    assert found(spark, docs, queries, **of) == brute(docs, queries, of.get("k", 20))


def test_nulls_empties_ties_and_repeats(spark):
    docs = [(1, "a b c"), (2, "a b c"), (2, "a b c"), (None, "a b c"), (3, None), (4, ""), (5, "-- .."), (6, "A-B_c!"), (7, "x " * 30_000 + "a"), (8, "y")] + [(i, "a") for i in range(20, 60)]
    queries = [(1, "c b"), (1, "c b"), (None, "a"), (2, None), (3, ""), (4, "y Y y")]
    assert found(spark, docs, queries, k=5) == brute(docs, queries, 5)
    assert found(spark, [], queries) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], queries) == []


def test_bounds_hold_and_prune():
    """No row below its bound, and the coordinate bound leaves few rows when the threshold is high."""
    import numpy as np

    rng = np.random.default_rng(1)
    weight = rng.integers(0, 9000, 300)
    rows = [np.sort(rng.choice(300, rng.integers(1, 60), replace=False)) for _ in range(500)]
    values = [rng.integers(1, 1_000_000, len(r)) for r in rows]
    root = np.sqrt(weight.astype(float))
    length = [float(np.sqrt(((root[r] * v) ** 2).sum())) * (1 + 1e-9) for r, v in zip(rows, values)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(500)), "terms": [r.tolist() for r in rows], "impacts": [v.tolist() for v in values], "length": length},
                                       pa.schema([("id", pa.int64()), ("terms", pa.list_(pa.int32())), ("impacts", pa.list_(pa.int64())), ("length", pa.float64())]))
    bucket = impacts.Bucket(batch.slice(100, 300), root)
    for _ in range(20):
        terms = np.sort(rng.choice(300, 25, replace=False))
        q = impacts.Queries([terms], [rng.integers(1, 4, 25)], weight)
        gain = np.zeros(300, np.int64)
        gain[terms] = weight[terms] * q.times[0]
        scores = bucket.scores(np.arange(300), gain)
        expected = [sum(int(gain[t]) * int(v) for t, v in zip(rows[i], values[i])) for i in range(100, 400)]
        assert scores.tolist() == expected
        least = float(np.sort(scores)[-20])
        left = bucket.reaching(terms, q.vectors[0], float(q.lengths[0]), least, 8)
        assert set(np.flatnonzero(scores >= least)) <= set(left.tolist()) and len(left) < 300
