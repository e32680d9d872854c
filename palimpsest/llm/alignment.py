"""Alignment of two tokenizers over the same texts, and corpus-wide counts of the ids that they link.

Every whole text is encoded by a byte-level BPE (A) and by a piece model (B). Offsets where tokens of both end are shared ends.
A shared end before which both next tokens carry a space mark is an anchor: it cuts the text into windows of about a word, each
a tuple of A ids and a tuple of B ids. Equal windows align equally, so their groups and links are worked out once and
remembered by the two tuples.

Links are counted in blocks of bounded size first: a task writes its documents with places into the block's list of distinct
pairs, so only (block, pair) rows are shuffled and joined with the corpus-wide counts, never (document, pair) rows. A pair that
every document has is one row per block.

Nulls, empty texts and texts that either tokenizer does not give back byte by byte have no tokens and zeros. Rows that repeat
are counted each. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from palimpsest.llm.held import held
from palimpsest.llm.textarrays import mix
from palimpsest.operators.lineage import checkpoint_root

#: How the byte-level BPE cuts texts before merging, and the mark of a space in pieces.
CUT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARK = "▁"

#: Links of one block (a longer text is a block of its own), code points encoded at once, and windows remembered, in two generations.
BLOCK_LINKS = 1 << 20
ENCODED_CHARS = 1 << 19
REMEMBERED = 1 << 18

ALIGNED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
SPANS = "a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>"


@dataclass(frozen=True)
class Vocabularies:
    """The two vocabulary files as read on the driver; their size is that of the vocabularies."""

    byte_level: bytes
    pieces: bytes

    @property
    def digest(self) -> str:
        return sha256(sha256(self.byte_level).digest() + self.pieces).hexdigest()


def read_vocabularies(byte_level: str, pieces: str) -> Vocabularies:
    with open(byte_level, "rb") as a, open(pieces, "rb") as b:
        return Vocabularies(a.read(), b.read())


def _byte_of_letter() -> dict[str, int]:
    """The byte behind each letter of byte-level entries: printable Latin-1 letters are themselves, the rest follow from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


class Aligner:
    """Encoders of both sides with byte lengths by id, and the windows seen so far."""

    def __init__(self, vocabularies: Vocabularies):
        import sentencepiece
        import tiktoken

        file = json.loads(vocabularies.byte_level)
        letters, added = _byte_of_letter(), {t["content"] for t in file["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in added}
        order = [file["model"]["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in file["model"]["merges"]]
        if order != sorted(order):
            raise ValueError("ids of the byte-level vocabulary must follow the order of its merges")
        self.a = tiktoken.Encoding("a", pat_str=CUT_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.pieces)
        raw_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            raw_a[i] = token
        self.raw_b = [self._piece(i) for i in range(len(self.b))]
        self.length_a, self.length_b = (np.array([len(t) for t in raw], np.int64) for raw in (raw_a, self.raw_b))
        self.opens_a, self.opens_b = (np.array([t[:1] == b" " for t in raw]) for raw in (raw_a, self.raw_b))
        decimal = [str(i) for i in range(max(len(raw_a), len(self.raw_b)))]
        self.digits = np.array([len(d) for d in decimal], np.int64)
        self.texts_a, self.texts_b = (tuple(np.array([d + end for d in decimal], object) for end in "," + last) for last in "|;")
        self.windows: dict[tuple[bytes, bytes], tuple[str, bytes]] = {}
        self.older = self.windows

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[1:-1], 16)])
        if self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_unused(i):
            return b""
        return self.b.id_to_piece(i).replace(MARK, " ").encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of each whole text by both sides; None without tokens."""
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            whole = (" " + text).encode()
            a = self.a.encode_ordinary(" " + text) if text else []
            if not a or b"".join([self.raw_b[i] for i in b]) != whole or self.a.decode_bytes(a) != whole:
                yield None
            else:
                yield np.array(a, np.int32), np.array(b, np.int32)

    def align(self, ids: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[str, np.ndarray]]:
        """For each text its groups as decimal ids and its links as b << 32 | a, in order.

        Windows of all texts are told apart by a hash first and compared in full with the first of theirs; each distinct one is
        looked up by its two tuples of ids, and those not seen before are aligned together.
        """
        if not ids:
            return []
        a, b = (np.concatenate([pair[side] for pair in ids]) for side in (0, 1))
        cuts = [self.anchors(*pair) for pair in ids]
        windows = np.cumsum([0, *[len(at) for at, _ in cuts]])
        stops = []
        for side in (0, 1):
            before = np.cumsum([0, *[len(pair[side]) for pair in ids]])[:-1]
            stops.append(np.concatenate([at[side] for at in cuts]) + np.repeat(before, np.diff(windows)))
        first, which = same_windows(a, b, *stops)
        raw_a, raw_b, keys = a.tobytes(), b.tobytes(), []
        bounds = [(4 * np.append(0, stop[:-1])[first]).tolist() + (4 * stop[first]).tolist() for stop in stops]
        n = len(first)
        for p, r, q, s in zip(bounds[0][:n], bounds[0][n:], bounds[1][:n], bounds[1][n:]):
            keys.append((raw_a[p:r], raw_b[q:s]))
        seen, older = self.windows, self.older
        new = [key for key in keys if key not in seen and key not in older]
        if new:
            seen.update(zip(new, self._windows(new)))
        found = [seen.get(key) or older[key] for key in keys]
        texts = np.array([f[0] for f in found], object)[which]
        links = np.frombuffer(b"".join([f[1] for f in found]), np.int64)
        size = np.array([len(f[1]) // 8 for f in found], np.int64)
        links = links[spread(np.cumsum(size) - size, size, which)]
        at = np.append(0, np.cumsum(size[which]))[windows].tolist()
        if len(seen) > REMEMBERED // 2:
            self.older, self.windows = seen, {}
        return [(";".join(texts[p:q].tolist()), links[r:s]) for p, q, r, s in zip(windows[:-1].tolist(), windows[1:].tolist(), at[:-1], at[1:])]

    def anchors(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the A and B tokens with a space mark that begin together, but the first, and the ends of both texts."""
        open_a, open_b = np.flatnonzero(self.opens_a[a[1:]]) + 1, np.flatnonzero(self.opens_b[b[1:]]) + 1
        start_a, start_b = np.cumsum(self.length_a[a])[open_a - 1], np.cumsum(self.length_b[b])[open_b - 1]
        place = np.minimum(np.searchsorted(start_a, start_b), max(0, len(start_a) - 1))
        both = np.flatnonzero(start_a[place] == start_b) if len(start_a) else np.zeros(0, np.int64)
        return np.append(open_a[place[both]], len(a)), np.append(open_b[both], len(b))

    def shared_ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the A and B tokens that end together."""
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        place = np.searchsorted(ends_a, ends_b)
        both = np.flatnonzero(ends_a[place] == ends_b)
        return place[both], both

    def _windows(self, keys: list[tuple[bytes, bytes]]) -> list[tuple[str, bytes]]:
        """Groups and links of windows. Both sides of a window have the same bytes, so windows laid end to end align as one text."""
        a, b = (np.frombuffer(b"".join([k[side] for k in keys]), np.int32) for side in (0, 1))
        at_a, at_b = self.shared_ends(a, b)
        ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        ends_a[at_a] = ends_b[at_b] = True
        group_a, group_b = (np.cumsum(e) - e for e in (ends_a, ends_b))  # tokens of a group: first those of A, then those of B
        place_a = np.arange(len(a)) + np.append(0, at_b + 1)[group_a]
        place_b = np.arange(len(b)) + (at_a + 1)[group_b]
        parts, sizes = np.empty(len(a) + len(b), object), np.empty(len(a) + len(b), np.int64)
        for ids, ends, place, inner, last in ((a, ends_a, place_a, *self.texts_a), (b, ends_b, place_b, *self.texts_b)):
            parts[place] = np.where(ends, last[ids], inner[ids])
            sizes[place] = self.digits[ids] + 1
        text, chars = "".join(parts.tolist()), np.append(0, np.cumsum(sizes))
        links = (b[at_b].astype(np.int64) << 32 | a[at_a]).tobytes()
        last_a, last_b = (np.cumsum([len(k[side]) // 4 for k in keys]) for side in (0, 1))
        group = 8 * (np.cumsum(ends_b)[last_b - 1])
        stops, groups, out, p, q = chars[last_a + last_b].tolist(), group.tolist(), [], 0, 0
        for r, s in zip(stops, groups):
            out.append((text[p : r - 1], links[q:s]))
            p, q = r, s
        return out


def spread(starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places of the values of the runs `which`, one run after the other."""
    size = sizes[which]
    return np.arange(size.sum()) + np.repeat(starts[which] - (np.cumsum(size) - size), size)


def same_windows(a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first window of each distinct pair of id tuples, and for every window the place of its first one in that list."""
    marks = np.zeros(len(stop_a), np.uint64)
    same = np.ones(len(stop_a), bool)
    sides = []
    for ids, stop, seed in ((a, stop_a, 1), (b, stop_b, 2)):
        start = np.append(0, stop[:-1])
        size = stop - start
        within = (np.arange(len(ids)) - np.repeat(start, size)).astype(np.uint64)
        marks = mix(marks + np.add.reduceat(mix(ids.astype(np.uint64) + mix(within * np.uint64(4) + np.uint64(seed))), start))
        sides.append((ids, start, size))
    _, first, which = np.unique(marks, return_index=True, return_inverse=True)
    for ids, start, size in sides:
        model = first[which]
        fits = size[model] == size
        equal = ids[spread(start, size, np.where(fits, model, np.arange(len(size))))] == ids
        same &= fits & np.logical_and.reduceat(equal, start)
    if not same.all():  # two contents with one mark: each window that differs from the first stands for itself
        odd = np.flatnonzero(~same)
        which[odd] = len(first) + np.arange(len(odd))
        first = np.append(first, odd)
    return first, which


def _texts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch from each place on, null as empty, a bounded number of code points at once."""
    start, size, part = 0, 0, []
    for i, value in enumerate(column):
        text = value.as_py() or ""
        if part and size + len(text) > ENCODED_CHARS:
            yield start, part
            start, size, part = i, 0, []
        part.append(text)
        size += len(text)
    if part:
        yield start, part


def aligned_blocks(docs: DataFrame, vocabularies: Vocabularies, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """Per text a row of `ALIGNED` (and `SPANS` if asked for) under the id, with the places (`at`) of its distinct links in the
    list of its block and how often it has each (`times`); per block a row with `links`, each b << 32 | a, and `link_times`."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabularies)
    kept = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    extra = f", {SPANS}" if spans else ""
    schema = StructType([StructField("block", LongType()), *StructType.fromDDL(f"id long, {ALIGNED}{extra}, at array<int>, times array<int>, links array<long>, link_times array<long>").fields])
    schema["id"].dataType = kept.schema["id"].dataType

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from palimpsest.llm.arrow import rows_of

        vocabularies = shared.value
        aligner = held("aligner", vocabularies.digest, lambda: Aligner(vocabularies))
        own, number = TaskContext.get().partitionId() << 32, 0
        rows: list[list] = []
        links: list[np.ndarray] = []

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal number
            distinct, places, times = np.unique(np.concatenate([np.zeros(0, np.int64), *links]), return_inverse=True, return_counts=True)
            start = 0
            for row, found in zip(rows, links):
                at, n = np.unique(places[start : start + len(found)], return_counts=True)
                row += [at.astype(np.int32), n.astype(np.int32), None, None]
                row[0] = own + number
                start += len(found)
            rows.append([own + number, *[None] * (len(schema) - 3), distinct, times])
            yield rows_of(rows, schema)
            number += 1
            rows.clear()
            links.clear()

        size = 0
        for batch in batches:
            for start, texts in _texts(batch.column("text")):
                both = list(aligner.encode(texts))
                told = iter(aligner.align([ids for ids in both if ids]))
                for id, ids in zip(batch.column("id").slice(start, len(texts)), both):
                    if ids is None:
                        row, found = [None, id.as_py(), 0, 0, 0, 0, "", *[[]] * (4 * spans)], np.zeros(0, np.int64)
                    else:
                        text, found = next(told)
                        row = [None, id.as_py(), len(ids[0]), len(ids[1]), len(found), len(found), sha256(text.encode()).hexdigest()]
                        if spans:
                            row += [*ids, *[at.astype(np.int32) for at in aligner.shared_ends(*ids)]]
                    if rows and size + len(found) > BLOCK_LINKS:
                        yield from block()
                        size = 0
                    rows.append(row)
                    links.append(found)
                    size += len(found) + 16
        if rows:
            yield from block()

    return kept.mapInArrow(align, schema)


def link_counts(blocks: DataFrame) -> DataFrame:
    """Corpus-wide `count` of each pair (`link`), and whether it is the highest of its B id (`best`), ties included."""
    spread = blocks.filter("links IS NOT NULL").select(F.explode(F.arrays_zip("links", "link_times")).alias("l"))
    counts = spread.groupBy(F.col("l.links").alias("link")).agg(F.sum("l.link_times").alias("count"))
    b = F.shiftright("link", 32)
    top = counts.groupBy(b.alias("b")).agg(F.max("count").alias("top"))  # a row per id of B's vocabulary, within 2^31 entries of its file
    return counts.withColumn("b", b).join(F.broadcast(top), "b").select("link", "count", (F.col("count") == F.col("top")).alias("best"))


def aligned(docs: DataFrame, vocabularies: Vocabularies, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """One row per text: the id, `ALIGNED` (and `SPANS`), `n_best` and `count_sum` over its links."""
    spark = docs.sparkSession
    folder = f"{checkpoint_root(spark)}/alignment-{uuid4().hex}"
    aligned_blocks(docs, vocabularies, id_col, text_col, spans).write.parquet(folder)  # texts are encoded once
    blocks = spark.read.parquet(folder)
    places = blocks.filter("links IS NOT NULL").select("block", F.posexplode("links").alias("place", "link"))
    counts = places.join(link_counts(blocks), "link").select("block", "place", "count", "best")
    rows = spark.read.parquet(folder).filter("links IS NULL").drop("links", "link_times")
    out = StructType([f for f in rows.schema.fields if f.name not in ("block", "at", "times")] + StructType.fromDDL("n_best long, count_sum long").fields)

    def told(rows: pa.Table, counts: pa.Table) -> pa.Table:
        place = counts["place"].to_numpy()
        count, best = np.zeros(len(place) + 1, np.int64), np.zeros(len(place) + 1, np.int64)
        count[place], best[place] = counts["count"].to_numpy(), counts["best"].to_numpy()
        at, times = (rows[c].combine_chunks() for c in ("at", "times"))
        weight, bounds = times.values.to_numpy(), at.offsets.to_numpy()
        sums = []
        for of in (best, count):
            total = np.concatenate([[0], np.cumsum(of[at.values.to_numpy()] * weight)])
            sums.append(pa.array(total[bounds[1:]] - total[bounds[:-1]]))
        return pa.table([rows[f.name] for f in out.fields[:-2]] + sums, names=out.names)

    named = rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(told, out)
    return named.withColumnRenamed("id", id_col)
