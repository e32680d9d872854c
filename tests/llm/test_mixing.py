from __future__ import annotations

import math
import random
from collections import Counter

from palimpsest.llm import mixing
from palimpsest.llm.mixing import MixConfig

from .helpers import WORD, documents, draw, targets


def brute(rows, plain=False):
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    goal = targets(sizes)
    out = []
    for id, text, _, source in rows:
        size = len(WORD.findall(text or ""))
        rate = goal[source] / sizes[source] if sizes[source] else 0.0
        out.append((id, size, sizes[source], goal[source], math.floor(rate) + (draw(id, text) < rate - math.floor(rate))))
    return out if plain else sorted(out, key=repr)


def unsorted(rows):
    return brute(rows, plain=True)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.copies").collect()), key=repr)


def test_mix_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (i, " ".join("w" for _ in range(rng.randint(0, 40))) if i % 11 else None, None, rng.choice([None, "", "a", "B", "é", "zz", "z", "s0", "s0", "s0", "s0"]))
        for i in range(500)
    ]
    docs = documents(spark, rows)
    mixed = mixing.mixed(docs)
    assert result(mixed) == brute(rows)
    assert mixed.columns == [*[c for c in docs.columns if c != "mix"], "mix"]
    again = mixing.emitted(docs.repartition(3))
    assert again.columns == docs.columns and {r["mix"] for r in again.select("mix").collect()} == {"x"}
    taken = Counter(r["doc_id"] for r in again.select("doc_id").collect())
    assert taken == Counter({r[0]: r[4] for r in brute(rows) if r[4]})


def test_small_sources_stop_at_three_times_their_size(spark):
    rows = [(1, "w", None, "a")] + [(i, "w " * 50, None, "b") for i in range(2, 60)]
    got = result(mixing.mixed(documents(spark, rows).drop("mix")))
    assert got == brute(rows) and got[0][3:] == (3.0, 3)


def test_tables_without_words_or_rows(spark):
    rows = [(1, None, None, None), (2, " ", None, "s")]
    assert result(mixing.mixed(documents(spark, rows))) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.emitted(documents(spark, rows)).count() == 0
    assert result(mixing.mixed(documents(spark, []))) == []


def test_ranks_over_several_parts(spark):
    names = [None] + [f"s{i:03d}" for i in range(97)]
    sums = spark.createDataFrame([(n is None, n) for n in names], "missing boolean, source string")
    got = {r["source"]: r["place"] for r in mixing.ranked(sums, per_part=10).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda n: (n is None, n or "")))}


def test_rows_draw_by_id_and_text(spark):
    """Rows without an id, or of one id, still come near the target of their source."""
    rows = [(None if i % 2 else 7, f"a b {i}", None, f"s{i % 4}") for i in range(2000)]
    got = mixing.mixed(documents(spark, rows), MixConfig()).select("source", "mix.*").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(f"s{i % 4}", *b[1:]) for i, b in zip(range(2000), unsorted(rows))], key=repr)
    for s in ("s0", "s1", "s2", "s3"):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) / own[0]["target"] - 1) < 0.15
