from __future__ import annotations

import random

import numpy as np
import pytest

from palimpsest.llm import minhash
from palimpsest.llm.components import components
from palimpsest.llm.minhash import NearConfig

from .helpers import documents, near_components, shingles


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def drifting(rng, n, words):
    """Texts that follow each other by small edits, so that ends of a chain are far apart."""
    text = [rng.choice(words) for _ in range(60)]
    for _ in range(n):
        yield " ".join(text)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(60)] = rng.choice(words)


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(spark, k):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    texts = [t for _ in range(5) for t in drifting(rng, 14, words)]
    texts += [texts[0].upper()] * 5 + ["", None, " \n", "one", "ONE", "one two", "two one", "one two three four"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert result(minhash.near_duplicates(documents(spark, rows), NearConfig(words=k))) == sorted(near_components(rows, k), key=repr)


def test_crowded_buckets_lose_no_link(spark):
    """Signatures of one bin put nearly all texts into common buckets; links must then come from the stars."""
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(150)]
    found = result(minhash.near_duplicates(documents(spark, rows), NearConfig(words=2, bands=40, rows=1)))
    assert found == sorted(near_components(rows, 2), key=repr)


def test_null_ids_empty_table_and_long_text(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [(3, long), (9, long + " more"), (None, long), (None, None)]
    assert result(minhash.near_duplicates(documents(spark, rows), NearConfig())) == sorted(
        [(3, 59_996, 3, True), (9, 59_997, 3, False), (None, 59_996, None, True), (None, 0, None, True)], key=repr
    )
    assert result(minhash.near_duplicates(documents(spark, []), NearConfig())) == []


def test_shingles_equal_brute_force():
    texts = ["", "a", "A b", "a B a b a b", "x\x0by\tz É é", "😀 😀 😀", "a\x85b c"]
    for k in (1, 2, 3, 5):
        assert [len(s) for s in minhash.shingle_sets(texts, k)] == [len(shingles(t, k)) for t in texts]


def test_bands_meet_as_often_as_the_similarity_says():
    rng = np.random.default_rng(3)
    cfg = NearConfig()
    for size, shared in ((10, 8), (400, 320)):  # sparse signatures are densified, full ones are not
        met = []
        for _ in range(200):
            both = rng.integers(0, 1 << 63, shared + 2 * (size - shared)).astype(np.uint64)
            a, b = np.unique(both[:size]), np.unique(np.concatenate([both[:shared], both[size:]]))
            met.append((minhash.band_keys(a, cfg) == minhash.band_keys(b, cfg)).mean())
        similarity = shared / (2 * size - shared)
        assert abs(np.mean(met) - similarity**cfg.rows) < 0.03


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100)] + [(200, j) for j in range(201, 260)] + [(300, 300)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(101)}, **{j: 200 for j in range(200, 260)}, 300: 300}
