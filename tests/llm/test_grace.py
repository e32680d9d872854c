from __future__ import annotations

import random

from palimpsest.llm import grace
from palimpsest.llm.grace import ContentTable, GraceConfig

from .helpers import documents, exact_groups

ROWS = [(1, "a b"), (2, "ab"), (3, " a\tb "), (4, None), (5, ""), (6, " \n"), (7, "é\x0b😀"), (8, "é😀"), (9, "x" * 200_000), (10, "x" * 200_000), (11, "a\x85b"), (12, "a b"), (13, "A B")]


def result(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_groups_equal_brute_force(spark):
    assert result(grace.exact_duplicates(documents(spark, ROWS))) == sorted(exact_groups(ROWS), key=repr)


def test_overflow_goes_to_further_levels(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 5)))) for i in range(400)]
    small = GraceConfig(table_bytes=2000, merge_bytes=1000, buckets_per_task=1)
    assert result(grace.exact_duplicates(documents(spark, rows).repartition(3), small)) == sorted(exact_groups(rows), key=repr)


def test_ties_repeated_rows_and_null_ids(spark):
    rows = [(5, "t"), (5, "t"), (2, " t"), (None, " t"), (None, "alone")]
    assert result(grace.exact_duplicates(documents(spark, rows))) == sorted(exact_groups(rows), key=repr)


def test_empty_table(spark):
    assert result(grace.exact_duplicates(documents(spark, []))) == []


def test_table_tells_colliding_keys_apart():
    table = ContentTable()
    for n in range(3000):
        content = str(n).encode()
        slot = table.find(n % 7, content)
        assert slot < 0
        table.add(slot, n % 7, content, (-1, False, n), 1)
    assert all(table.contents[table.find(n % 7, str(n).encode())] == str(n).encode() for n in range(3000))
