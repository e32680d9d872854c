"""Exact deduplication as a Grace hash join of the records with themselves.

Level by level, records are partitioned by a hash of their content into buckets, through Spark's shuffle files. A task
holds one bucket in an open-addressing table that compares complete contents. Once the table has reached its budget it
takes no new content: records of contents that it holds are still merged, all others overflow, and the overflow is
partitioned again by the hash of the next level. All copies of a content share a bucket at every level, so they overflow
together or not at all. Copies are merged inside every scan task before the first shuffle.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.textarrays import ASCII_SPACE
from palimpsest.operators.lineage import cut

_DROPPED = ASCII_SPACE.encode()


@dataclass(frozen=True)
class GraceConfig:
    """Bytes of distinct content that a bucket's table holds, the same for merging inside a scan task, and the buckets per
    scan task. The number of buckets grows with the scan; the budget bounds memory however they turn out."""

    table_bytes: int = 96 << 20
    merge_bytes: int = 16 << 20
    buckets_per_task: int = 4
    max_levels: int = 64


class ContentTable:
    """Open addressing with linear probing over complete contents; each entry keeps its best row and a row count."""

    def __init__(self) -> None:
        self.slots = array("q", [-1]) * 1024
        self.keys: list[int] = []
        self.contents: list[bytes] = []
        self.best: list[tuple] = []
        self.rows: list[int] = []
        self.bytes = 0

    def find(self, key: int, content: bytes) -> int:
        """Index of the entry, or the complement of the free slot where it would go."""
        slots, mask = self.slots, len(self.slots) - 1
        at = key & mask
        while (entry := slots[at]) >= 0:
            if self.keys[entry] == key and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        return ~at

    def add(self, slot: int, key: int, content: bytes, best: tuple, rows: int) -> None:
        self.slots[~slot] = len(self.keys)
        self.keys.append(key)
        self.contents.append(content)
        self.best.append(best)
        self.rows.append(rows)
        self.bytes += len(content) + 200
        if 2 * len(self.keys) > len(self.slots):
            self._grow()

    def merge(self, entry: int, best: tuple, rows: int) -> None:
        self.rows[entry] += rows
        if best < self.best[entry]:
            self.best[entry] = best

    def _grow(self) -> None:
        self.slots = slots = array("q", [-1]) * (4 * len(self.slots))
        mask = len(slots) - 1
        for entry, key in enumerate(self.keys):
            at = key & mask
            while slots[at] >= 0:
                at = (at + 1) & mask
            slots[at] = entry


def normalised(text: bytes | None) -> bytes:
    return b"" if text is None else text.translate(None, _DROPPED)


def _best(chars: int, id: object) -> tuple:
    """Sorts the row that stays first: most code points, then smallest id, null ids last."""
    return (-chars, id is None, id)


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _rows(table: ContentTable, schema: pa.Schema, with_content: bool, step: int = 2048) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(table.keys), step):
        part = slice(a, a + step)
        contents = table.contents[part]
        yield _batch(
            [
                table.keys[part],
                [sha256(c).hexdigest() for c in contents],
                contents if with_content else [None] * len(contents),
                [-b[0] for b in table.best[part]],
                [b[2] for b in table.best[part]],
                table.rows[part],
            ],
            schema,
        )


def _merger(schema: pa.Schema, budget: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for batch in batches:
            ids, chars, texts = (batch.column(k).to_pylist() for k in range(3))
            for id, n, text in zip(ids, chars, texts):
                content = normalised(text)
                key = int.from_bytes(sha256(content).digest()[:8], "big", signed=True)
                entry = table.find(key, content)
                if entry >= 0:
                    table.merge(entry, _best(n, id), 1)
                else:
                    table.add(entry, key, content, _best(n, id), 1)
                    if table.bytes > budget:
                        yield from _rows(table, schema, True)
                        table = ContentTable()
        yield from _rows(table, schema, True)

    return merge


def _bucket(schema: pa.Schema, budget: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ContentTable()
        for batch in batches:
            over = []
            keys, contents, chars, ids, rows = (batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))
            for at, (key, content, n, id, count) in enumerate(zip(keys, contents, chars, ids, rows)):
                entry = table.find(key, content)
                if entry >= 0:
                    table.merge(entry, _best(n, id), count)
                elif table.bytes <= budget:
                    table.add(entry, key, content, _best(n, id), count)
                else:
                    over.append(at)
            if over:
                yield pa.RecordBatch.from_arrays(batch.take(pa.array(over)).columns, schema=schema)
        yield from _rows(table, schema, False)

    return build


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


@F.arrow_udf(T.StringType())
def content_digest(texts: pa.Array) -> pa.Array:
    """sha256 of the normalised text, lower-case hex; a null text counts as empty."""
    return pa.array([sha256(normalised(t)).hexdigest() for t in texts.to_pylist()], pa.string())


def content_groups(docs: DataFrame, cfg: GraceConfig = GraceConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct normalised content: `text_sha256`, `keep_id`, `group_size`. Empty tables give no rows."""
    text = F.col(text_col)
    scanned = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("chars"), text.cast("binary").alias("text")
    )
    shape = T.StructType(
        [
            T.StructField("key", T.LongType()),
            T.StructField("sha", T.StringType()),
            T.StructField("content", T.BinaryType()),
            T.StructField("chars", T.LongType()),
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("rows", T.LongType()),
        ]
    )
    arrow = _arrow_schema(shape)
    buckets = max(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), cfg.buckets_per_task * docs.rdd.getNumPartitions()
    )
    pending = scanned.mapInArrow(_merger(arrow, cfg.merge_bytes), shape)
    found: DataFrame | None = None
    for level in range(cfg.max_levels):
        dealt = pending.repartition(buckets, F.xxhash64("key", F.lit(level)))
        out = cut(dealt.mapInArrow(_bucket(arrow, cfg.table_bytes), shape))
        groups = out.filter("content IS NULL").select(
            F.col("sha").alias("text_sha256"), F.col("id").alias("keep_id"), F.col("rows").alias("group_size")
        )
        found = groups if found is None else found.union(groups)
        pending = out.filter("content IS NOT NULL")
        if pending.isEmpty():
            return found
    raise RuntimeError(f"content still overflows after {cfg.max_levels} levels; give the tables more bytes or use more buckets")


def exact_duplicates(docs: DataFrame, cfg: GraceConfig = GraceConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, `keep_id`, `group_size`, `kept`, `text_sha256`.

    Texts are equal if they are the same without ASCII white space; null counts as empty. The row with the most code points
    stays, then the smallest id; a null id comes last and is kept only if its group has no other. Rows that repeat an id and
    a text count in `group_size` and are all kept if that id is. Other columns of `docs` are not read.

    Contents are shuffled once, after merging; the rows themselves only meet the groups of two or more rows, by digest. That
    join's hot key is one group of many copies, whose side Spark splits.
    """
    groups = content_groups(docs, cfg, id_col, text_col).filter("group_size > 1").withColumnRenamed("text_sha256", "sha")
    rows = docs.select(F.col(id_col).alias("id"), content_digest(F.col(text_col).cast("binary")).alias("text_sha256"))
    joined = rows.join(groups, rows["text_sha256"] == groups["sha"], "left")
    keep = F.when(F.col("sha").isNotNull(), F.col("keep_id")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )
