from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np

from palimpsest.llm import toxicity
from palimpsest.llm.toxicity import ToxicityConfig, log_ratios, word_counts

from .helpers import documents

SMALL = ToxicityConfig(slot_bits=16)


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(20_000)]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                text[rng.randrange(len(text))] = rng.choice(["Vile!", "awful", "nasty."])
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return rows, labels


def test_ratios_equal_brute_force(spark):
    rows = [("The cat, the DOG", 1), ("the cat", 0), ("a cat_dog é", 0), ("the", None), (None, 1)]
    cfg = ToxicityConfig(slot_bits=20)
    ratios = log_ratios(word_counts(spark.createDataFrame(rows, "text string, label int"), cfg), cfg)
    words = [(re.findall(r"[^\W_]+", (t or "").lower()), y) for t, y in rows]
    seen = sorted({w for ws, _ in words for w in ws})
    c = {k: {w: sum(ws.count(w) for ws, y in words if y == k) for w in seen} for k in (0, 1)}
    docs = {w: sum(w in ws for ws, _ in words) for w in seen}
    z = {k: sum(max(v - cfg.discount, 0) for v in c[k].values()) for k in (0, 1)}
    p = lambda k, w: (1 - cfg.shared) * max(c[k][w] - cfg.discount, 0) / z[k] + cfg.shared * docs[w] / sum(docs.values())
    slots = toxicity.word_slots([" ".join(seen)], cfg.slot_bits)[1]
    assert np.allclose(ratios[slots], [np.log(p(1, w) / p(0, w)) for w in seen], atol=1e-5)


def test_held_out_documents_are_found(spark):
    rows, labels = corpus(3000)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.scored(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), SMALL).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(i for i in got if got[i]["held_out"]) == held
    truth, guess = np.array([i % 5 == 0 for i in held]), np.array([got[i]["predicted"] == 1 for i in held])
    assert (truth & guess).sum() / truth.sum() > 0.8 and (truth & guess).sum() / guess.sum() > 0.9


def test_held_out_labels_teach_nothing(spark):
    rows, labels = corpus(400)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (
        sorted((r["doc_id"], r["toxicity"]["score"]) for r in toxicity.scored(documents(spark, rows), spark.createDataFrame(x, "doc_id long, toxic int"), SMALL).collect())
        for x in (labels, turned)
    )
    assert np.allclose([s for _, s in a], [s for _, s in b])


def test_odd_texts_and_labels(spark):
    rows, labels = corpus(200)
    rows += [(900, None), (901, ""), (902, "?! _"), (903, "w1 " * 50_000), (None, "awful"), rows[0], rows[0]]
    labels += [(900, 1), (None, 1), (901, None), (0, 0), (12345, 1)]
    docs = documents(spark, rows)
    df = toxicity.scored(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), SMALL)
    assert df.columns == [*[c for c in docs.columns if c != "toxicity"], "toxicity"]
    got = df.collect()
    assert len(got) == len(rows) and all(0 <= r["toxicity"]["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["toxicity"] for r in got}
    assert by[900]["score"] == by[901]["score"] == by[902]["score"] and not by[None]["held_out"]


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(documents(spark, []), none, SMALL).count() == 0
    (row,) = toxicity.scored(documents(spark, [(1, "a")]), none, SMALL).collect()
    assert abs(row["toxicity"]["score"] - 0.05) < 1e-9


def test_words_never_share_a_count(spark):
    # 3,000 ordinary words against 2^7 broadcast ones: each word has its own ratio, whether it is broadcast or joined.
    rows, labels = corpus(400)
    rows += [rows[1], rows[1], (None, rows[5][1]), (901, "")]
    docs, known = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    few, all_ = (
        sorted(((r["doc_id"], r["text"], r["toxicity"]["score"]) for r in toxicity.scored(docs, known, ToxicityConfig(slot_bits=b)).collect()), key=repr)
        for b in (7, 22)
    )
    assert [r[:2] for r in few] == [r[:2] for r in all_]
    assert np.allclose([r[2] for r in few], [r[2] for r in all_], atol=1e-9)


def test_broadcast_is_bounded_and_the_rest_is_complete(spark):
    rows = [(" ".join(f"v{i + k}" for k in range(20)), i % 2) for i in range(300)] + [("plain words", None)]
    cfg = ToxicityConfig(slot_bits=5)
    counts = word_counts(spark.createDataFrame(rows, "text string, label int"), cfg)
    common, rare = toxicity.ratio_tables(counts, cfg)
    assert counts.count() == 321 and common.count() <= 32
    assert common.count() + rare.count() + 2 == 321 and not common.join(rare, "word").count()


def log_likelihood(texts, symbols, order):
    """log P(text) by recursion over the contexts, from plain lists of n-grams."""
    marked = lambda t: [toxicity.FIRST] * (order - 1) + list(" ".join(re.findall(r"[^\W_]+", t.lower()))) + [toxicity.LAST]
    grams = lambda t: [tuple(m[i : i + order]) for m in [marked(t)] for i in range(len(m) - order + 1)] if re.search(r"[^\W_]", t) else []
    levels = {order: Counter(g for t in texts for g in grams(t))}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    off = {n: toxicity.discounts([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]) for n, c in levels.items()}

    def p(g):
        if not g:
            return 1.0 / (symbols + 1)
        n = len(g)
        after = [v for h, v in levels[n].items() if h[:-1] == g[:-1]]
        if not after:
            return p(g[1:])
        d = lambda v: off[n][min(v, 3) - 1] if v else 0.0
        v = levels[n][g]
        return (v - d(v) + sum(map(d, after)) * p(g[1:])) / sum(after)

    return lambda t: (sum(np.log(p(g)) for g in grams(t)), len(grams(t)))


def test_means_equal_brute_force(spark):
    rows = [("The cat, the DOG", 1), ("the cat", 0), ("a cat_dog é", 0), ("dog the", None), (None, 1), ("tag the god", 0), ("Cad! cat", 1), ("?!", 0)]
    asked = ["the cat", "god", "zz top", "cad é", "", "a  the"]
    for cfg in (ToxicityConfig(order=3), ToxicityConfig(order=3, slot_bits=3)):
        table, base = toxicity.gram_ratios(toxicity.gram_counts(spark.createDataFrame(rows, "text string, label int"), cfg), cfg)
        keyed = table.mapInArrow(toxicity._keyed, "word long, documents long, ratio float").localCheckpoint()
        common, rare = toxicity.most_common(keyed, cfg)
        ratios = spark.sparkContext.broadcast(toxicity._held(common))
        texts = spark.createDataFrame([(t,) for t in asked], "text string")
        got = {r["text"]: r["_mean"] for r in toxicity._with_mean(texts, texts["text"], ratios, rare, base, cfg.order).collect()}
        symbols = len({c for t, y in rows if t and y is not None for w in re.findall(r"[^\W_]+", t.lower()) for c in w} | {" ", toxicity.LAST})
        sides = [log_likelihood([t for t, y in rows if t and y == k], symbols, cfg.order) for k in (1, 0)]
        for t in asked:
            (a, n), (b, _) = (f(t) for f in sides)
            assert abs(got[t] - (a - b) / max(1, n)) < 1e-5, (t, got[t], a, b)


def test_order_of_words_counts(spark):
    # The classes hold the same words, in another order.
    rng = random.Random(3)
    rows = [(i, " ".join(("big dog" if i % 2 else "dog big") if rng.random() < 0.5 else "or" for _ in range(20))) for i in range(600)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    got = [(r["doc_id"], r["toxicity"]) for r in toxicity.scored(documents(spark, rows), labels, SMALL).collect()]
    held = [(i % 2, t["predicted"]) for i, t in got if t["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.9
