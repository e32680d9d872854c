"""The registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from palimpsest.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# One or two queries per family; tools/check_oracle.py runs all of them.
SAMPLE = [
    "session_prune_audit", "survivor_split", "unit_zones", "hysteresis_audit", "request_replay", "prefix_stability_quantum", "rolling_latency",
    "carbon_ledger", "long_chain_verification", "rehydration_lookup", "effort_policy", "secret_findings", "hardened_report", "cycle_decay",
    "model_report", "wilcoxon", "cache_study_summary", "growing_summary", "interval_energy", "keep_latest", "stream_model_totals", "protocol_repair",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def test_every_oracle_belongs_to_a_query():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    assert set(registry.QUERIES) - set(registry.ORACLES) == set()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    rows = registry.QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    got = sorted(map(repr, ([r[c] for c in columns] for r in rows.collect())))
    result = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(map(repr, ([r[names.index(c)] for c in columns] for r in result.fetchall())))
    assert [g.replace("-0.0", "0.0") for g in got] == [w.replace("-0.0", "0.0") for w in want]


def test_python_workers_find_the_package_from_any_folder(tmp_path):
    """A query with a Python function, started where the repository is not on the workers' path."""
    code = (
        f"import sys; sys.path.insert(0, {os.path.dirname(os.path.abspath(entry.__file__))!r}); import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        f"print('rows', e.queries()['hash_chain'](s, {SF!r}).count())"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in done.stdout, done.stderr[-2000:]
