from __future__ import annotations

import random

import pytest

from palimpsest.llm import pieces
from palimpsest.llm.pieces import MARK, Encoder
from palimpsest.llm.queries import PIECES
from pyspark.sql import functions as F

from .helpers import documents


@pytest.fixture(scope="module")
def table():
    return pieces.read_pieces(PIECES)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    parts = ["the", "Ing", "tion", " ", " ", "  ", "é", "ß", "\n", "\t", "x", "9", ",", "日本", "Ⅷ", "😀", "\u0301", "qu", "ation", "<s>", "<0x41>", "\r\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", " ", "a", "\n"]


def search_all(table, text):
    """The greatest total score over all ways to cut the text, by plain dynamic programming over every piece."""
    scores = {p: s for p, s in zip(table.pieces, table.scores) if p}
    unknown = min(scores.values()) - pieces.UNKNOWN_PENALTY
    marked = MARK + text.replace(" ", MARK) if text else ""
    best = [0.0] + [float("-inf")] * len(marked)
    for end in range(1, len(marked) + 1):
        for start in range(max(0, end - 20), end):
            if (s := scores.get(marked[start:end])) is not None:
                best[end] = max(best[end], best[start] + s)
        if marked[end - 1] not in scores:
            best[end] = max(best[end], best[end - 1] + unknown)
    return best[-1]


def total(table, ids):
    raw = set(table.bytes)
    plain = [i for i in ids if i not in raw]
    return sum(table.scores[i] for i in plain)


def test_scores_are_the_best_of_all_cuts(table, texts):
    encoder = Encoder(table)
    scores = {p: s for p, s in zip(table.pieces, table.scores) if p}
    unknown = min(scores.values()) - pieces.UNKNOWN_PENALTY
    for text in texts:
        own = total(table, encoder.encode(text)) + sum(unknown for c in text.replace(" ", MARK) if c not in scores)
        assert own == search_all(table, text)


def test_round_trip(table, texts):
    encoder = Encoder(table)
    assert all(encoder.decode(encoder.encode(t)) == t for t in texts)
    assert encoder.decode(encoder.encode(f"a{MARK}b")) == "a b"


def test_same_score_as_the_library(table):
    """The best of the library's own lattice search in unigram mode over the same table; its 32-bit sums hold these scores exactly."""
    sentencepiece = pytest.importorskip("sentencepiece")
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = proto.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    encoder, rng = Encoder(table), random.Random(3)
    for _ in range(200):
        text = " ".join("".join(rng.choice(["th", "e", "ing", "r", "qu", "a", "é", "st"]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12)))
        assert total(table, encoder.encode(text)) == total(table, library.nbest_encode_as_ids(text, 2)[0])


def test_columns(spark, table, texts):
    rows = list(enumerate(texts)) + [(1000, None), (1001, "word " * 40_000), (None, "a"), (5, texts[5])]
    docs = documents(spark, rows)
    df = pieces.encoded_documents(docs, table).withColumn("back", pieces.decoded(spark, F.col("tokens"), table)).withColumn("p", pieces.audit(spark, F.col("text"), table))
    got = df.select("doc_id", "text", "tokens", "back", "p.*").collect()
    encoder = Encoder(table)
    assert len(got) == len(rows)
    for r in got:
        assert r["tokens"] == list(encoder.encode(r["text"] or "")) and r["back"] == (r["text"] or "") and r["exact"] and r["n_tokens"] == len(r["tokens"])
    assert pieces.encoded_documents(documents(spark, []), table).count() == 0
    nulls = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r[0] for r in nulls.select(pieces.decoded(spark, F.col("ids"), table)).collect()] == [None, ""]


def test_another_table_is_another_encoder(spark, table, texts):
    """Workers are used again; ids always come from the table that was given."""
    letters = pieces.PieceTable([p if p and len(p) == 1 else None for p in table.pieces], table.scores, table.bytes, table.unknown)
    docs = documents(spark, list(enumerate(texts[:60]))).repartition(2).cache()
    want = {id(t): {i: list(Encoder(t).encode(x)) for i, x in enumerate(texts[:60])} for t in (table, letters)}
    for t in (table, letters, table, letters, letters, table):
        assert {r["doc_id"]: r["tokens"] for r in pieces.encoded_documents(docs, t).collect()} == want[id(t)]


def test_memory_is_bounded(table, texts, monkeypatch):
    whole = Encoder(table)
    monkeypatch.setattr(pieces, "REMEMBERED_BYTES", 4000)
    short = Encoder(table)
    for t in texts:
        assert short.encode(t) == whole.encode(t) and len(short) < 20
    long = "x" * 300_000
    assert whole.decode(whole.encode(long)) == long and not any(len(w) > pieces.REMEMBERED_CHARS for w in whole)
