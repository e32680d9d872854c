"""The stages one by one against plain Python, and the registered queries against their SQL."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from palimpsest.llm import pieces, queries
from palimpsest.llm.pieces import Encoder

from .helpers import WORD, counts, draw, exact_groups, near_components, targets

SF = "/root/testdata/sf0.001"
TABLES = "documents pages labels benchmark embeddings".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    rows = entry.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted(repr([r[c] for c in columns]) for r in rows.collect())
    if name not in queries.ORACLES:
        assert len(got) == duck.execute("select count(*) from documents").fetchone()[0]
        return
    result = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr([r[names.index(c)] for c in columns]) for r in result.fetchall())


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        rows = [(r["doc_id"], r["text"]) for r in before]
        out = stage(spark, docs, SF)
        after = [r.asDict() for r in out.collect()]
        ids = Counter(r["doc_id"] for r in after)
        if name != "encode":
            assert out.columns == columns and all(r in before for r in after)
        if name == "quality rules":
            for id, text in rows:
                n = counts(text)
                if n[0] < 20 or 100 * n[4] > 30 * n[0]:
                    assert id not in ids
            assert len(after) > 0.7 * len(before)
        elif name == "exact dedup":
            assert sorted(ids) == sorted(id for id, _, _, kept, _ in exact_groups(rows) if kept)
        elif name == "near dedup":
            assert sorted(ids) == sorted(id for id, _, _, kept in near_components(rows, 5) if kept)
        elif name == "mix":
            sizes = Counter()
            for r in before:
                sizes[r["source"]] += len(WORD.findall(r["text"]))
            goal = targets(sizes)
            rate = {s: goal[s] / sizes[s] for s in sizes}
            want = {r["doc_id"]: math.floor(rate[r["source"]]) + (draw(r["doc_id"], r["text"]) < rate[r["source"]] % 1) for r in before}
            assert ids == Counter({k: v for k, v in want.items() if v})
        else:
            encoder = Encoder(pieces.read_pieces(queries.PIECES))
            text = dict(rows)
            assert all(r["tokens"] == list(encoder.encode(text[r["doc_id"]])) and r["n_tokens"] == len(r["tokens"]) for r in after)
            assert ids == Counter(id for id, _ in rows)
        docs = spark.createDataFrame(after, out.schema) if name != "encode" else out


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "tokens"] and out.count() > 50
