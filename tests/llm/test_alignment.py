from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import alignment
from palimpsest.llm.alignment import Aligner
from palimpsest.llm.queries import BYTE_LEVEL, PIECES

from .helpers import documents


@pytest.fixture(scope="module")
def vocabularies():
    return alignment.read_vocabularies(BYTE_LEVEL, PIECES)


def brute(texts):
    """Rows by the libraries themselves and a walk over all byte offsets."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(BYTE_LEVEL)
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    entries = {i: bytes(letters[c] for c in t) for t, i in json.load(open(BYTE_LEVEL))["model"]["vocab"].items() if t != "<|endoftext|>"}
    rows, pairs = [], []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        raw_b = [bytes([int(p[3:-1], 16)]) if b_side.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_side.id_to_piece(i)) for i in b)]
        raw_a = [entries[i] for i in a]
        if not text or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            rows.append((0, 0, 0, ""))
            pairs.append([])
            continue
        ends_a, ends_b = {}, {}
        for ends, raw in ((ends_a, raw_a), (ends_b, raw_b)):
            at = 0
            for k, token in enumerate(raw):
                at += len(token)
                ends[at] = k
        groups, links, p, q = [], [], 0, 0
        for end in sorted(ends_a.keys() & ends_b.keys()):
            r, s = ends_a[end] + 1, ends_b[end] + 1
            groups.append(",".join(map(str, a[p:r])) + "|" + ",".join(map(str, b[q:s])))
            links.append((a[r - 1], b[s - 1]))
            p, q = r, s
        rows.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        pairs.append(links)
    counts = Counter(link for links in pairs for link in links)
    top = {}
    for (a, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    return [
        (n_a, n_b, n, len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), digest)
        for (n_a, n_b, n, digest), links in zip(rows, pairs)
    ]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    parts = ["the", "Ing", "tion", " ", " ", " ", "  ", "é", "ß", "\n", "\t", "x", "9", "42", ",", "日本", "Ⅷ", "😀", "́", "'s", "qu", "<s>", "<|endoftext|>", "<0x41>", "\r\n", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_rows(spark, vocabularies, monkeypatch):
    texts = random_texts(300) + ["", None, " ", "a▁b", "nul\0l", "word " * 5_000, "x" * 30_000, "twice twice", "twice twice"]
    docs = documents(spark, list(enumerate(texts)) + [(None, "null id")])
    got = {r[0]: tuple(r)[1:] for r in alignment.aligned(docs.repartition(3), vocabularies).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    expected = brute(texts + ["null id"])
    assert got == dict(zip([*range(len(texts)), None], expected))
    assert got[300] == got[301] == got[303] == (0, 0, 0, 0, 0, 0, "")
    assert alignment.aligned(documents(spark, []), vocabularies).count() == 0


def test_blocks_and_spans(spark, vocabularies):
    texts = random_texts(60, seed=9)
    docs = documents(spark, list(enumerate(texts)))
    rows = alignment.aligned(docs, vocabularies, spans=True).filter("n_a > 0").collect()
    aligner = Aligner(vocabularies)
    for r in rows:
        raw_a = b"".join(aligner.a.decode_single_token_bytes(i) for i in r["a_ids"])
        assert raw_a == (" " + texts[r["doc_id"]]).encode() == b"".join(aligner.raw_b[i] for i in r["b_ids"])
        assert len(r["a_ends"]) == len(r["b_ends"]) == r["n_groups"]
        for i, j in zip(r["a_ends"], r["b_ends"]):
            assert sum(len(aligner.a.decode_single_token_bytes(t)) for t in r["a_ids"][: i + 1]) == sum(len(aligner.raw_b[t]) for t in r["b_ids"][: j + 1])


def test_small_blocks_and_short_memory(vocabularies, monkeypatch):
    """Windows forgotten and windows that share a hash change nothing."""
    texts = [t for t in random_texts(80, seed=3) if t]
    whole = Aligner(vocabularies)
    pairs = [p for p in whole.encode(texts) if p is not None]
    expected = whole.align(pairs)
    monkeypatch.setattr(alignment, "REMEMBERED", 2)
    short = Aligner(vocabularies)
    again = [short.align([p])[0] for p in pairs]
    monkeypatch.setattr(alignment, "mix", lambda x: x * np.uint64(0))
    one = Aligner(vocabularies).align(pairs)
    for other in (again, one):
        assert [t for t, _ in other] == [t for t, _ in expected]
        assert all((x == y).all() for (_, x), (_, y) in zip(other, expected))


def test_same_classes_of_letters_as_the_file(vocabularies):
    """The merging library cuts texts as the file's own library does, for every code point."""
    from tokenizers import Tokenizer

    own, aligner = Tokenizer.from_file(BYTE_LEVEL), Aligner(vocabularies)
    own.encode_special_tokens = True
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    points = points[:0x3000] + points[0x3000::37]
    for at in range(0, len(points), 2000):
        text = "".join(f"x{chr(c)}y1{chr(c)}{chr(c)}2 {chr(c)}.  {chr(c)} \n" for c in points[at : at + 2000])
        assert aligner.a.encode_ordinary(text) == own.encode(text, add_special_tokens=False).ids
