"""Near-duplicates by one-permutation hashing.

Every document becomes the set of its word shingles. One hash of a shingle gives both a bin and a value, and a bin keeps
its smallest value; an empty bin takes the value of the first filled bin in a fixed random order of its own, which is
optimal densification. Bands of bins are bucket keys.
A bucket proposes only links from one centre to its other members, a star, and each proposed link is confirmed on the full
sets. Where a bucket still holds members of different components, its members outside the largest of them meet the others
once more, behind three filters: the sizes, the distances to the centre, and sketches of 4,096 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.components import components
from palimpsest.llm.tables import counted_hint
from palimpsest.llm.textarrays import U64, Chunk, chunks, hash_spans, mix, spaces
from palimpsest.operators.lineage import cut


#: Bits of a sketch, taken from signatures of so many bins each.
SKETCH_BITS = 4096
SKETCH_BINS = 2048

#: Sets made or sketched by one task: that work follows rows, while Spark joins small partitions by their bytes.
ROWS_PER_TASK = 2048


@dataclass(frozen=True)
class NearConfig:
    """Shingle length, similarity in percent, and the shape of the signature.

    With `bands` of `rows` bins, a pair at exactly 80 percent shares no bucket with probability (1 - 0.8^6)^48, about
    one in two million, and pairs at 10 percent meet with probability 5e-5.
    """

    words: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 6
    seed: int = 8

    @property
    def bins(self) -> int:
        return self.bands * self.rows


@lru_cache
def _orders(bins: int, seed: int) -> np.ndarray:
    """Rank of every bin in the random order of every other bin."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(bins) for _ in range(bins)]).astype(np.uint16)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text.

    A-Z are lower-cased, words are runs without ASCII white space; a text of fewer words is one shingle, a text without
    words has none.
    """
    chunk = Chunk(texts)
    codes = np.where((chunk.codes >= 65) & (chunk.codes <= 90), chunk.codes + 32, chunk.codes)
    starts, ends = chunk.spans(~spaces()[codes])
    hashes = hash_spans(codes, starts, ends)
    bounds = np.searchsorted(starts, np.concatenate([chunk.starts, [len(codes) + 1]]))
    sets = []
    step = U64(0x9FB21C651E98DF25)
    with np.errstate(over="ignore"):
        n = len(hashes) - words + 1
        windows = np.zeros(max(0, n), U64)
        for k in range(words):
            windows = windows * step + hashes[k : k + len(windows)]
        windows = mix(windows)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if b - a >= words:
                sets.append(np.unique(windows[a : b - words + 1]))
            elif b > a:
                whole = U64(b - a)
                for h in hashes[a:b]:
                    whole = whole * step + h
                sets.append(mix(np.array([whole])))
            else:
                sets.append(np.zeros(0, U64))
    return sets


def bin_values(shingles: np.ndarray, bins: int, seed: int) -> np.ndarray:
    """The densified signature of a set: one value per bin."""
    hashed = np.sort(mix(shingles ^ U64(seed)))
    at = ((hashed >> U64(32)) * U64(bins)) >> U64(32)  # grows with the hash, so the first of a bin is its minimum
    first = np.flatnonzero(np.diff(at, prepend=U64(bins)))
    filled = at[first].astype(np.int64)
    values = np.zeros(bins, U64)
    values[filled] = hashed[first]
    if len(filled) < bins:
        empty = np.ones(bins, bool)
        empty[filled] = False
        empty = np.flatnonzero(empty)
        values[empty] = values[filled[_orders(bins, seed)[np.ix_(empty, filled)].argmin(1)]]
    return values


def band_keys(shingles: np.ndarray, cfg: NearConfig) -> np.ndarray:
    """Bucket keys of one set, one per band."""
    with np.errstate(over="ignore"):
        keys = np.arange(cfg.bands, dtype=U64)
        for column in bin_values(shingles, cfg.bins, cfg.seed).reshape(cfg.bands, cfg.rows).T:
            keys = mix(keys * U64(0x9FB21C651E98DF25) + column)
    return keys


def sketch_bits(shingles: np.ndarray, cfg: NearConfig) -> np.ndarray:
    """One bit of each of `SKETCH_BITS` bins, as 64-bit numbers. Bits of a pair agree with probability (1 + similarity) / 2."""
    at = np.arange(SKETCH_BINS, dtype=U64) * U64(0x9FB21C651E98DF25)
    with np.errstate(over="ignore"):
        values = [mix(bin_values(shingles, SKETCH_BINS, cfg.seed + 1 + k) + at) for k in range(SKETCH_BITS // SKETCH_BINS)]
    return np.packbits((np.concatenate(values) & U64(1)).astype(np.uint8)).view(np.int64)


def _signature(cfg: NearConfig):
    @F.arrow_udf("struct<n_shingles: bigint, set_key: binary, keys: array<bigint>>")
    def signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes, names, keys = [], [], []
            for texts in chunks(batch):
                for s in shingle_sets(texts, cfg.words):
                    sizes.append(len(s))
                    names.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(band_keys(s, cfg).view(np.int64) if len(s) else None)
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                ["n_shingles", "set_key", "keys"],
            )

    return signature.asNondeterministic()


def _set(cfg: NearConfig):
    @F.arrow_udf("array<bigint>")
    def full_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(
                [s.view(np.int64) for texts in chunks(batch) for s in shingle_sets(texts, cfg.words)], pa.list_(pa.int64())
            )

    return full_set


def _confirmed(proposed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Proposed pairs (`a`, `b`) with `similarity` of the full sets and `linked`."""
    both = proposed.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a").join(
        sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b"
    )
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb") - shared).alias("together")).select(
        "a", "b", (100 * F.col("shared") >= percent * F.col("together")).alias("linked"), (F.col("shared") / F.col("together")).alias("similarity")
    )


def near_duplicates(docs: DataFrame, cfg: NearConfig = NearConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, `n_shingles`, `component_id`, `kept`.

    Two documents are linked if their shingle sets have a Jaccard similarity of `percent` or more; `component_id` is the
    smallest id that links reach, and the document with that id is kept. Null and empty texts have no shingles, are linked
    with nothing and kept. A null id can not name a component: such a row is kept, alone, with a null component. Rows that
    repeat an id share its component, each is kept if the id is; where their texts differ, links of that id are confirmed on
    the greatest text. Other columns of `docs` are not read.

    Documents of one set are one member from here on, so a group of copies of any size costs one row per document. What is
    shuffled per distinct set is its bucket keys; full sets move only for members of a bucket of two or more.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = cut(rows.withColumn("s", _signature(cfg)("text")).select("id", "s.*"))
    named = signed.filter((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    reps = named.groupBy("set_key").agg(
        F.min("id").alias("rep"), F.min_by("keys", "id").alias("keys"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies")
    )

    keyed = reps.select("rep", "n_shingles", F.explode("keys").alias("bucket"))
    crowded = keyed.groupBy("bucket").agg(F.min("rep").alias("centre"), F.min_by("n_shingles", "rep").alias("size"), F.count("*").alias("n"))
    members = cut(keyed.join(crowded.filter("n > 1").select("bucket", "centre", "size"), "bucket"))

    wanted = cut(members.select("rep").distinct())
    n = wanted.count()
    tasks = max(1, -(-n // ROWS_PER_TASK))
    chosen = rows.join(counted_hint(wanted, n), rows["id"] == wanted["rep"], "left_semi").select(F.col("id").alias("rep"), "text")
    texts = chosen.repartition(tasks, "rep").groupBy("rep").agg(F.max("text").alias("text"))
    sets = cut(texts.select("rep", _set(cfg)("text").alias("shingles")))

    close = _sizes_fit(cfg, "n_shingles", "size")
    stars = members.filter("rep <> centre")
    proposed = stars.filter(close).select(F.col("rep").alias("a"), F.col("centre").alias("b")).distinct()
    decided = cut(_confirmed(proposed, sets, cfg.percent))
    labels = components(decided.filter("linked").select("a", "b"))
    more = _confirmed(_left_over(stars, labels, decided, sets, tasks, cfg), sets, cfg.percent)
    linked = cut(more.filter("linked").select("a", "b"))
    if not linked.isEmpty():
        labels = components(decided.filter("linked").select("a", "b").union(linked))

    moved = reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id"), ((F.col("copies") > 1) | F.col("component").isNotNull()).alias("moved")
    ).filter("moved").drop("moved")
    return signed.join(moved, "set_key", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )


def _sizes_fit(cfg: NearConfig, a: str, b: str) -> Column:
    """The similarity of sets of these sizes can reach the threshold."""
    return 100 * F.least(a, b) >= cfg.percent * F.greatest(a, b)


def _left_over(stars: DataFrame, labels: DataFrame, decided: DataFrame, sets: DataFrame, tasks: int, cfg: NearConfig) -> DataFrame:
    """Pairs (`a` > `b`) still to be confirmed, of buckets whose members lie in several components.

    Members of the largest component of a bucket are connected already, so each pair has a member outside it: one large
    group with few others stays linear. A pair is passed on if

    * its sizes and its distances to the centre (1 - similarity is a metric) allow the similarity, which loses nothing;
    * its sketches differ in no more bits than a pair at the threshold does with a chance of one in 10^8;
    * it meets in the first of the buckets that both are in, so it comes once.
    """
    held = stars.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = held.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("bucket").agg(
        F.count("*").alias("parts"), F.max(F.struct("n", "component")).getField("component").alias("major")
    ).filter("parts > 1").select("bucket", "major")
    far = decided.select(F.col("a").alias("rep"), F.col("b").alias("centre"), (1 - F.col("similarity")).alias("far"))
    held = cut(held.join(mixed, "bucket").join(far, ["rep", "centre"], "left").select("bucket", "major", "rep", "component", "n_shingles", "far"))
    own = held.groupBy("rep").agg(F.collect_list("bucket").alias("buckets"))  # at most one bucket per band
    held = held.join(sets.repartition(tasks, "rep").join(own.repartition(tasks, "rep"), "rep").select("rep", "buckets", _sketch(cfg)("shingles").alias("bits")), "rep")

    x, y = (
        held.select("bucket", *[F.col(c).alias(f"{c}{k}") for c in ("major", "rep", "component", "n_shingles", "far", "bits", "buckets")]) for k in "xy"
    )
    differing = sum(F.bit_count(F.col("bitsx")[k].bitwiseXOR(F.col("bitsy")[k])) for k in range(SKETCH_BITS // 64))
    reach = F.coalesce(F.abs(F.col("farx") - F.col("fary")) <= 1 - cfg.percent / 100 + 1e-9, F.lit(True))
    met = x.filter("componentx <> majorx").join(
        y,
        (x["bucket"] == y["bucket"])
        & (F.col("componentx") != F.col("componenty"))
        & ((F.col("componenty") == F.col("majory")) | (F.col("repx") > F.col("repy")))
        & _sizes_fit(cfg, "n_shinglesx", "n_shinglesy")
        & reach
        & (differing <= most_differing(cfg))
        & (x["bucket"] == F.array_min(F.array_intersect("bucketsx", "bucketsy"))),
    )
    return met.select(F.greatest("repx", "repy").alias("a"), F.least("repx", "repy").alias("b"))


def most_differing(cfg: NearConfig) -> int:
    """Bits in which the sketches of a pair at the threshold differ at most: the mean and 5.6 standard deviations."""
    p = (1 - cfg.percent / 100) / 2
    return int(SKETCH_BITS * p + 5.6 * (SKETCH_BITS * p * (1 - p)) ** 0.5) + 1


def _sketch(cfg: NearConfig):
    @F.arrow_udf("array<bigint>")
    def sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            bounds, flat = batch.offsets.to_numpy(), batch.values.to_numpy().view(U64)
            yield pa.array([sketch_bits(flat[a:b], cfg) for a, b in zip(bounds[:-1], bounds[1:])], pa.list_(pa.int64()))

    return sketch
