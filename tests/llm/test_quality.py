from __future__ import annotations

import random

import numpy as np

from palimpsest.llm import boosting, quality
from palimpsest.llm.textstats import COUNTS, FEATURES, statistics

from .helpers import counts, documents

ALPHABET = ["a", "b ", "c\n", "\n", " ", "#", "é", "😀", "a b ", "\t", "\x0b", "\x85", "  ", "B!", "9"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 200))) for _ in range(n)] + ["", "a", "a\n\na\n", "\n", "w " * 5000]


def test_counts_equal_brute_force():
    many = texts(300)
    assert statistics(many)[0].tolist() == [counts(t) for t in many]


def test_monotonic_features_never_raise_the_score():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(20 * x[:, 0]) + 0.5 * x[:, 1] + 0.2 * rng.random(3000)) < 0.8).astype(int)
    trees = boosting.train(x, y, [-1, 0, 1])
    base = rng.random((200, 3))
    for feature, sign in ((0, -1), (2, 1)):
        grid = []
        for v in np.linspace(0, 1, 50):
            moved = base.copy()
            moved[:, feature] = v
            grid.append(trees.probability(moved))
        assert (sign * np.diff(np.array(grid), axis=0) >= -1e-12).all()
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.85


def test_training_does_not_depend_on_row_order():
    rng = np.random.default_rng(3)
    x, y = rng.random((500, 2)), rng.integers(0, 2, 500)
    back = rng.permutation(500)
    a, b = boosting.train(x, y, [0, 0]), boosting.train(x[back], y[back], [0, 0])
    assert np.allclose(a.probability(x), b.probability(x))


def test_verdicts(spark):
    good = " ".join(f"word{i}" for i in range(40))
    bad = " ".join(f"w{i}***###" for i in range(40))
    rows = [(i, good + f" n{i}") for i in range(60)] + [(100 + i, bad + f" n{i}") for i in range(60)]
    rows += [(200, None), (201, ""), (202, "short text"), (203, "a b c d e f g h i j " * 6), (204, good), (None, good), (205, "word " * 30_000)]
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(None, 0), (7, None)], "doc_id long, quality int")
    docs = documents(spark, rows).drop("quality")
    judged = quality.judged(docs, labels)
    assert judged.columns == [*docs.columns, "quality"]
    got = {r["doc_id"]: r["quality"].asDict() for r in judged.collect()}
    for id, text in rows:
        assert [got[id][c] for c in COUNTS] == counts(text)
        assert got[id]["base_failed"] == (counts(text)[0] < 20 or 100 * counts(text)[4] > 30 * counts(text)[0])
    assert all(got[i]["kept"] for i in [*range(60), 204, None]) and not any(got[i]["kept"] for i in [*range(100, 160), 200, 201, 202, 203, 205])


def test_without_labels_only_the_base_rule_counts(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(1, " ".join(f"w{i}***" for i in range(40))), (2, "w")]
    got = {r["doc_id"]: r["quality"]["kept"] for r in quality.judged(documents(spark, rows), labels).collect()}
    assert got == {1: True, 2: False}
    assert quality.judged(documents(spark, []), labels).count() == 0


def test_features_have_a_sign_each():
    assert statistics(["x"])[1].shape == (1, len(FEATURES))
