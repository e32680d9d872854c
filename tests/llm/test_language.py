from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import language
from palimpsest.llm.language import Landmarks, LanguageConfig, gram_sets

from .helpers import documents

SF = "/root/testdata/sf0.01"


def test_kernel_equals_brute_force():
    texts = ["Abc, de!", "abcd", "été ñ", "", "123", "日本語 abc"]
    read = lambda t: [ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % 36 if c.isalpha() else 0 for c in t.lower()]
    sets = [{(n, tuple(s[i : i + n])) for s in [read(t)] for n in (1, 2, 3) for i in range(len(s) - n + 1)} for t in texts]
    got, lettered = gram_sets(texts)
    assert [len(g) for g in got] == [len(s) for s in sets] and lettered.tolist() == [True, True, True, False, False, True]
    marks = [0, 2, 5]
    want = [[len(a & sets[m]) / np.sqrt(len(a) * len(sets[m])) if a else 0 for m in marks] for a in sets]
    assert np.allclose(Landmarks([got[m] for m in marks]).kernel(got), want, atol=1e-5)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identified(docs).select("doc_id", "text", "lang", "language.*")
    rows = got.collect()
    assert all(r["held_out"] == (__import__("zlib").crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"] and any(c.isalpha() for c in r["text"])]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    other = docs.withColumn("lang", F.when(held, "xx").otherwise(F.col("lang")))
    a, b = (sorted((r["doc_id"], r["language"]["lang_pred"]) for r in language.identified(d).collect()) for d in (docs, other))
    assert a == b


def test_odd_texts(spark):
    rng = random.Random(1)
    speak = lambda alphabet, n: " ".join("".join(rng.choice(alphabet) for _ in range(5)) for _ in range(n))
    rows = [(i, speak("abcde", 20), "p") for i in range(40)] + [(100 + i, speak("vwxyz", 20), "q") for i in range(40)]
    rows += [(200, None, "p"), (201, "", "q"), (202, "12 345 !?", "p"), (203, speak("abcde", 40_000), None), (None, speak("vwxyz", 9), "p"), (204, "a", None)]
    rows += [rows[0]] * 3
    docs = documents(spark, rows)
    df = language.identified(docs, LanguageConfig(sample=40, landmarks=8))
    assert df.columns == [*[c for c in docs.columns if c != "language"], "language"]
    got = {r["doc_id"]: r["language"] for r in df.collect()}
    assert all(got[i]["lang_pred"] == "p" for i in [*range(40), 203]) and all(got[100 + i]["lang_pred"] == "q" for i in range(40))
    assert got[None]["lang_pred"] == "q" and got[None]["held_out"] is False
    assert [tuple(got[i])[1:] for i in (200, 201, 202)] == [("und", 0.0)] * 3


def test_nothing_to_learn_from(spark):
    assert language.identified(documents(spark, [])).count() == 0
    (row,) = language.identified(documents(spark, [(1, "text", None)])).collect()
    assert tuple(row["language"])[1:] == ("und", 0.0)


def test_more_languages_than_are_learned(spark):
    """The most common ones are learned; the others are never predicted, and a repeated id counts once."""
    letters = "abcdefghij"
    rows = [(i, " ".join(letters[i % 5] * 3 + letters[(i + 5) % 10] for _ in range(8)), f"l{i % 5}" if i < 300 else f"rare{i}") for i in range(340)]
    rows += [rows[0]] * 50
    cfg = language.LanguageConfig(sample=100, landmarks=20, languages=5)
    got = {r["language"]["lang_pred"] for r in language.identified(documents(spark, rows), cfg).collect()}
    assert got <= {f"l{k}" for k in range(5)} and len(got) > 1
