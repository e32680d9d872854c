from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import fixity
from palimpsest.llm.fixity import FixityConfig

SHAPE = "file string, offset long, length long, digest string"


def archive(rng, files, records):
    out = []
    for f in range(files):
        at = 0
        for _ in range(rng.randint(0, records)):
            n = rng.randint(1, 300)
            out.append((f"dir/f{f:03d}", at, n, f"{rng.random():.9f}"))
            at += n
    return out


def found(spark, a, b, cfg):
    rows = fixity.faults(spark.createDataFrame(a, SHAPE), spark.createDataFrame(b, SHAPE), cfg).collect()
    return sorted((r["file"], r["offset"], r["status"], r["expected_digest"], r["found_digest"]) for r in rows)


@pytest.mark.parametrize("files", [1, 3, 60])
def test_faults_equal_brute_force(spark, files):
    rng = random.Random(files)
    cfg = FixityConfig(range_bytes=500, group_files=4)
    a = archive(rng, files, 40)
    b, want = [], []
    for r in a:
        roll = rng.random()
        if roll < 0.03:
            want.append((r[0], r[1], "missing", r[3], ""))
        elif roll < 0.06:
            b.append((*r[:3], "bad"))
            want.append((r[0], r[1], "altered", r[3], "bad"))
        else:
            b.append(r)
    b.append(("dir/extra", 0, 5, "new"))
    want.append(("dir/extra", 0, "extra", "", "new"))
    assert [tuple(x or "" if k > 2 else x for k, x in enumerate(r)) for r in found(spark, a, b, cfg)] == sorted(want)


def test_equal_and_empty_replicas(spark):
    rng = random.Random(9)
    a = archive(rng, 4, 20)
    assert found(spark, a, rng.sample(a, len(a)), FixityConfig()) == []
    assert found(spark, [], [], FixityConfig()) == []
    assert len(found(spark, a, [], FixityConfig())) == len(a)


def test_nulls_and_repeated_offsets(spark):
    a = [(None, None, None, None), ("f", 0, 3, "x"), ("f", 0, 3, "x"), ("f", 0, 3, "y")]
    assert found(spark, a, a, FixityConfig()) == []
    got = found(spark, a, a[:3], FixityConfig())
    assert got == [("f", 0, "missing", "y", None)]


def test_only_differing_branches_are_open(spark):
    """The roots of equal replicas are equal, and one altered record changes one path from record to root."""
    rng = random.Random(2)
    a = archive(rng, 20, 40)
    b = list(a)
    b[100] = (*a[100][:3], "bad")
    cfg = FixityConfig(range_bytes=500, group_files=4)
    frames = [spark.createDataFrame(x, SHAPE) for x in (a, b)]
    depth = fixity.depth_of(frames, cfg)
    for x, y in zip(*(fixity.tree(f, depth, cfg) for f in frames)):
        assert x.select("path", "digest").exceptAll(y.select("path", "digest")).count() == 1


def test_layout(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "b", 2), (4, "a", 1)], "id long, f string, n long")
    laid = fixity.laid_out(rows, F.col("f"), ["id"], F.col("n"))
    assert sorted((r["file"], r["id"], r["offset"]) for r in laid.collect()) == [("a", 1, 0), ("a", 2, 5), ("a", 4, 12), ("b", 3, 0)]


def test_lost_and_added_repeats(spark):
    """A record that one replica has more often is a fault, with any number of repeats of no length in one range."""
    a = [("f", 0, 5, "d")] * 2 + [("f", 5, 0, "e")] * 500 + [("g", 0, 1, "x")]
    b = [("f", 0, 5, "d")] + [("f", 5, 0, "e")] * 501 + [("g", 0, 1, "x")]
    assert found(spark, a, b, FixityConfig()) == [("f", 0, "missing", "d", "d"), ("f", 5, "extra", "e", "e")]
    assert found(spark, a, a, FixityConfig()) == []
