from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import licences, queries
from palimpsest.llm.licences import LICENCES, NOTICES

from .helpers import documents

MIT = LICENCES["MIT"]
ROWS = [
    (1, MIT),
    (2, "Copyright (c) 2020 A. Author\n  # (C) other\n© more\n" + MIT.upper()),
    (3, MIT.replace("sublicense", "sub-licence").replace(", ", " ,\n* ").replace('"', "“")),
    (4, MIT + "\nand more"),
    (5, None),
    (6, ""),
    (7, "Copyright 2020\nAll rights reserved."),
    (8, "text\nreleased under the MIT licence\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License.\n"),
    (9, LICENCES["Zlib"].replace("acknowledgment", "acknowledgement")),
    (10, "x " * 100_000),
    (None, LICENCES["ISC"]),
    (1, MIT),
]


def test_whole_texts_and_lines(spark):
    docs = documents(spark, ROWS)
    df = licences.scanned(docs)
    assert df.columns == [*[c for c in docs.columns if c != "scan"], "scan"]
    got = sorted(((r["doc_id"], r["scan"]["licence"], r["scan"]["notices"]) for r in df.collect()), key=repr)
    want = [(1, "MIT", []), (1, "MIT", []), (2, "MIT", []), (3, "MIT", []), (8, None, ["CC-BY-NC-4.0", "MIT"]), (9, "Zlib", []), (None, "ISC", [])]
    want += [(i, None, []) for i in (4, 5, 6, 7, 10)]
    assert got == sorted(want, key=repr)


def test_every_known_text_finds_itself(spark):
    first = {k: of[0] for k, of in NOTICES.items()}
    rows = list(enumerate([*LICENCES.values(), *first.values()]))
    got = {r["doc_id"]: r["scan"] for r in licences.scanned(documents(spark, rows)).collect()}
    assert [got[i]["licence"] for i in range(len(LICENCES))] == list(LICENCES)
    assert [got[len(LICENCES) + i]["notices"] for i in range(len(first))] == [[k] for k in first]


def test_plan_is_native_and_empty_tables_work(spark):
    assert licences.scanned(documents(spark, [])).count() == 0
    plan = licences.scanned(documents(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_published_wrapping_and_titles(spark):
    wrapped_isc = LICENCES["ISC"].replace("above copyright", "above\ncopyright")
    wrapped_bsd = LICENCES["BSD-2-Clause"].replace("the above copyright", "the above\n   copyright").replace("THE COPYRIGHT HOLDER OR", "THE\nCOPYRIGHT HOLDER OR")
    rows = [
        (1, "ISC License\n\nCopyright (c) 2004-2010 by Some Holder\n\n" + wrapped_isc),
        (2, "Copyright Some Holder\n" + wrapped_bsd),
        (3, "MIT License\n\nCopyright (c) 2020 A. Author\n\n" + MIT),
        (4, "BSD 3-Clause License\n\nCopyright 2020, A\nAll rights reserved.\n\n" + LICENCES["BSD-3-Clause"]),
    ]
    got = {r["doc_id"]: r["scan"]["licence"] for r in licences.scanned(documents(spark, rows)).collect()}
    assert got == {1: "ISC", 2: "BSD-2-Clause", 3: "MIT", 4: "BSD-3-Clause"}


def test_statements_of_holders(spark):
    rows = [(1, "Copyright by Jane\n\n" + MIT), (2, "Copyright for portions of X are held by Y\n" + MIT), (3, "MIT License\n\n" + MIT), (4, "copyright notice here"), (5, "Copyright 2020\rcopyright me\n" + MIT)]
    got = {r["doc_id"]: r["scan"]["licence"] for r in licences.scanned(documents(spark, rows)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: "MIT"}


def test_tables_of_the_caller(spark):
    docs = documents(spark, [(1, "own  TERMS."), (2, MIT), (3, "given by digest"), (4, "Licensed under Own.")])
    digest = docs.select(licences.digest(F.lit("Given, by digest"))).first()[0]
    df = licences.scanned(docs, {"Own": ["Own terms"]}, {"Given": [digest]}, licences.notices({"Own": []}))
    assert {r["doc_id"]: (r["scan"]["licence"], r["scan"]["notices"]) for r in df.collect()} == {1: ("Own", []), 2: (None, []), 3: ("Given", []), 4: (None, ["Own"])}
    assert licences.scanned(docs, {}, {}, {}).filter("scan.licence IS NOT NULL OR size(scan.notices) > 0").count() == 0


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="needs the texts that come with the system")
def test_long_licences(spark):
    texts = {k: open(f"/usr/share/common-licenses/{f}", encoding="utf-8").read() for k, f in (("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"))}
    docs = documents(spark, [(i, " ".join(t.split(" "))) for i, t in enumerate(texts.values())] + [(9, texts["GPL-2.0"] + " and more")])
    got = {r["doc_id"]: r["scan"]["licence"] for r in licences.scanned(docs).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts) and got[9] is None


def test_sql_agrees_on_odd_texts(spark, tmp_path):
    """The comparison of the registered query, on the texts of these tests."""
    texts = [t for _, t in ROWS] + ["MIT License\n\n" + MIT, "copyright notice here", "Copyright by Jane\n" + MIT, "copyright\n" + MIT, "x\rcopyright y\n", " (C) a\n" + MIT, "SPDX-License-Identifier: GPL-3.0\nlicensed under the apache 2.0 license"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    result = con.execute(queries.ORACLES["op10_licence_scan"])
    names = [d[0] for d in result.description]
    want = sorted(tuple(dict(zip(names, r)).items()) for r in result.fetchall())
    got = sorted(tuple((c, r[c]) for c in names) for r in queries.licence_scan(spark, str(tmp_path)).collect())
    assert got == want
