"""Encoding and decoding with the pieces of a SentencePiece model.

An Aho-Corasick automaton over all pieces reads a text once. At every position it reports the pieces that end there, longest
first along its output links, and each of them relaxes the best score of that position: a Viterbi search for the pieces of
the greatest total score. Characters without a piece of their own fall back to byte pieces.

No piece goes on after a space mark that follows other characters, so a text falls apart before its words, and the best
pieces of a word are kept for its next occurrence. Models for which that does not hold are searched over whole texts.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.held import held

#: The mark of a space in pieces and what an unknown character costs below the worst piece.
MARK = "▁"
UNKNOWN_PENALTY = 10.0

#: Bytes of words and pieces that a worker remembers, in two generations, and the longest word remembered.
REMEMBERED_BYTES = 48 << 20
REMEMBERED_CHARS = 48


@dataclass(frozen=True)
class PieceTable:
    """The pieces of a model by id with their scores, ids of the 256 byte pieces, and the id for unknown characters."""

    pieces: list[str | None]
    scores: list[float]
    bytes: list[int]
    unknown: int

    def digest(self) -> str:
        return sha256(repr((self.pieces, self.scores, self.bytes, self.unknown)).encode()).hexdigest()


def read_pieces(path: str) -> PieceTable:
    """The table of a model file, read on the driver; its size is that of the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(len(model))
    plain = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids]
    numbered = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
    return PieceTable(
        [model.id_to_piece(i) if ok else None for i, ok in zip(ids, plain)],
        [model.get_score(i) for i in ids],
        [numbered[b] for b in range(256)] if len(numbered) == 256 else [],
        model.unk_id(),
    )


class Encoder(dict):
    """Best pieces by word, as the bytes of 32-bit ids; missing ones are searched."""

    def __init__(self, table: PieceTable):
        super().__init__()
        self.table = table
        self.held = 0
        self.older: dict[str, bytes] = {}
        own = [(p, i) for i, p in enumerate(table.pieces) if p]
        self.unknown_score = min(table.scores[i] for _, i in own) - UNKNOWN_PENALTY
        self.single = {p for p, _ in own if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in own:
            self.automaton.add_word(p, (len(p), table.scores[i], i))
        self.automaton.make_automaton()
        if any(MARK in p.lstrip(MARK) for p, _ in own):
            self.words = re.compile(r".+", re.S)
        else:
            alone = "".join(c for c in "\n\t\r" if not any(c in p for p, _ in own))
            self.words = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        self.raw = [
            b"" if p is None else p.replace(MARK, " ").encode() for p in table.pieces
        ]
        for b, i in enumerate(table.bytes):
            self.raw[i] = bytes([b])

    def __missing__(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = self.search(word).tobytes()
        if len(word) <= REMEMBERED_CHARS:
            self.held += 220 + 2 * len(word) + len(found)
            if self.held > REMEMBERED_BYTES // 2:
                self.older, self.held = dict(self), 0
                self.clear()
            self[word] = found
        return found

    def search(self, word: str) -> array:
        """Ids of the best pieces of a text; of equal scores the longer last piece wins. Long ones take 16 bytes a character."""
        n, single, unknown = len(word), self.single, self.unknown_score
        best, length, back = [float("-inf")], [1], [-1]
        if n > 1024:
            best, length, back = array("d", best), array("i", length), array("i", back)
        best, length, back = best * (n + 1), length * (n + 1), back * (n + 1)
        best[0] = 0.0
        done = 0  # best[:done + 1] is final
        for end, (size, score, piece) in self.automaton.iter(word):
            while done < end:
                # every piece that ends here was seen; a character without its own piece may still stand for itself
                if word[done] not in single and (value := best[done] + unknown) > best[done + 1]:
                    best[done + 1], length[done + 1], back[done + 1] = value, 1, -1
                done += 1
            if (value := best[end + 1 - size] + score) > best[end + 1]:
                best[end + 1], length[end + 1], back[end + 1] = value, size, piece
        while done < n:
            if word[done] not in single and (value := best[done] + unknown) > best[done + 1]:
                best[done + 1], length[done + 1], back[done + 1] = value, 1, -1
            done += 1
        ids, at, raw = array("i"), n, self.table.bytes
        while at:
            if back[at] >= 0:
                ids.append(back[at])
            elif raw:
                ids.extend([raw[b] for b in reversed(word[at - 1].encode())])
            else:
                ids.append(self.table.unknown)
            at -= length[at]
        ids.reverse()
        return ids

    def encode(self, text: str) -> array:
        ids = array("i")
        if text:
            ids.frombytes(b"".join([self[word] for word in self.words.findall(MARK + text.replace(" ", MARK))]))
        return ids

    def decode(self, ids) -> str:
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def _shared(spark: SparkSession, table: PieceTable):
    """The table with its digest, for the workers."""
    return spark.sparkContext.broadcast((table.digest(), table))


def _encoder(shared) -> Encoder:
    """The worker's one encoder; another table lets the one before go."""
    digest, table = shared.value
    return held("encoder", digest, lambda: Encoder(table))


def encoded(spark: SparkSession, text: Column, table: PieceTable) -> Column:
    """Token ids of whole texts; a null or empty text has none."""
    shared = _shared(spark, table)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared)
        for batch in batches:
            flat, offsets = array("i"), array("i", [0])
            for text in batch:
                flat.extend(encoder.encode(text.as_py() or ""))
                offsets.append(len(flat))
            yield pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))

    return encode(text)


def decoded(spark: SparkSession, ids: Column, table: PieceTable) -> Column:
    """Texts of token ids; null for null, and "" for none. Bytes that are no UTF-8 become replacement characters."""
    shared = _shared(spark, table)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared)
        for batch in batches:
            bounds, flat = batch.offsets.to_numpy(), batch.values.to_numpy()
            texts = [encoder.decode(flat[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.array([t if ok else None for t, ok in zip(texts, batch.is_valid().to_pylist())], pa.string())

    return decode(ids)


def audit(spark: SparkSession, text: Column, table: PieceTable) -> Column:
    """Struct of `n_tokens`, `n_byte_tokens`, `tokens_sha256` (of the ids as 32-bit little-endian integers) and `exact`: the
    decoded tokens are the text again. A null text counts as empty. Only a text with U+2581 itself is not exact."""
    shared = _shared(spark, table)

    @F.arrow_udf("struct<n_tokens: bigint, n_byte_tokens: bigint, tokens_sha256: string, exact: boolean>")
    def check(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(shared)
        is_byte = np.zeros(len(encoder.raw), bool)
        is_byte[encoder.table.bytes] = True
        for batch in batches:
            rows = []
            for value in batch:
                text = value.as_py()
                ids = encoder.encode(text or "")
                flat = np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)
                rows.append((len(ids), int(is_byte[flat].sum()), sha256(flat.tobytes()).hexdigest(), encoder.decode(ids) == (text or "")))
            n, byte, digest, exact = zip(*rows) if rows else ((), (), (), ())
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(byte, pa.int64()), pa.array(digest, pa.string()), pa.array(exact, pa.bool_())],
                ["n_tokens", "n_byte_tokens", "tokens_sha256", "exact"],
            )

    return check.asNondeterministic()(text)


def encoded_documents(docs: DataFrame, table: PieceTable, text_col: str = "text") -> DataFrame:
    """All columns of `docs` with `tokens`; a column of that name is replaced. Rows are encoded where they lie."""
    return docs.withColumn("tokens", encoded(docs.sparkSession, F.col(text_col), table))
