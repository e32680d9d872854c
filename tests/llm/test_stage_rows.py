"""The deduplicating stages on repeated ids, null ids and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .helpers import documents

BASE = " ".join(f"base{i}" for i in range(60))
OTHER = " ".join(f"other{i}" for i in range(60))
THIRD = " ".join(f"third{i}" for i in range(60))
STAGES = [corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup]


ODD = ["mix", "quality", "_row", "row", "whole", "key", "tokens", "a.b", "copies", "kept"]


def with_odd_columns(docs):
    """Extra columns whose names stages could use inside, one with a dot, one a map; their values follow from the id."""
    docs = docs.drop(*ODD)
    value = F.concat_ws("/", F.lit("own"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")))
    docs = docs.select("*", *[F.concat_ws(":", F.lit(c), value).alias(c) for c in ODD])
    return docs.withColumn("by", F.create_map(F.lit("k"), value))


def assert_unchanged(row):
    value = "own/" + ("?" if row["doc_id"] is None else str(row["doc_id"]))
    assert {c: row[c] for c in ODD} == {c: f"{c}:{value}" for c in ODD} and row["by"] == {"k": value}


def left(spark, stage, rows):
    docs = with_odd_columns(documents(spark, rows))
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    for r in out.collect():
        assert_unchanged(r)
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)


@pytest.mark.parametrize("stage", STAGES)
def test_a_repeated_id_loses_only_the_text_that_is_a_copy(spark, stage):
    rows = [(1, BASE), (2, BASE), (2, OTHER), (3, THIRD), (3, OTHER)]
    assert left(spark, stage, rows) == sorted([(1, BASE), (2, OTHER), (3, THIRD)], key=repr)


@pytest.mark.parametrize("stage", STAGES)
def test_repeated_rows_stay_once(spark, stage):
    assert left(spark, stage, [(1, BASE), (1, BASE), (2, BASE), (4, OTHER), (4, OTHER)]) == sorted([(1, BASE), (4, OTHER)], key=repr)
    assert left(spark, stage, [(1, BASE, "en"), (1, BASE, "de"), (1, BASE, None)]) == [(1, BASE)]


@pytest.mark.parametrize("stage", STAGES)
def test_null_ids_are_documents_like_others(spark, stage):
    rows = [(None, BASE), (None, BASE), (7, BASE), (None, OTHER), (None, OTHER), (None, THIRD)]
    assert left(spark, stage, rows) == sorted([(7, BASE), (None, OTHER), (None, THIRD)], key=repr)


def test_near_copies_under_one_id(spark):
    near = BASE + " more"
    assert left(spark, corpus_pipeline.near_dedup, [(5, near), (5, OTHER), (9, BASE), (None, BASE + " words")]) == sorted([(5, near), (5, OTHER)], key=repr)


@pytest.mark.parametrize("stage", STAGES)
def test_empty_table(spark, stage):
    assert left(spark, stage, []) == []


def test_other_stages_keep_every_column(spark, tmp_path):
    good = " ".join(f"word{i} and" for i in range(40)) + "."
    rows = [(1, good), (1, good), (2, good + " more"), (None, good), (3, None), (4, ""), (5, good + " x" * 60_000)]
    docs = with_odd_columns(documents(spark, rows))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality_rules(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    found = kept.collect()
    assert sorted(str(r["doc_id"]) for r in found) == ["1", "1", "2", "None"]
    taken = corpus_pipeline.mix(spark, docs, "")
    assert taken.columns == docs.columns
    for r in [*found, *taken.collect()]:
        assert_unchanged(r)
    ids = corpus_pipeline.encode(spark, docs, "").collect()
    assert len(ids) == 7 and {r["n_tokens"] for r in ids if r["doc_id"] in (3, 4)} == {0}
    empty = docs.limit(0)
    assert all(stage(spark, empty, str(tmp_path)).count() == 0 for _, stage in corpus_pipeline.STAGES)
