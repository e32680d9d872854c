"""Content-addressed store of purged units: what was pruned can be looked up again by its digest."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.config import BLOCK_ROWS

DIGEST_PATTERN = "^[0-9a-f]{64}$"

#: Fixed value: shards of a store, one per two hex digits.
SHARDS = 256

#: Messages of one document; a unit with more is stored in parts.
PART_ROWS = 4096


def is_digest(value: Column) -> Column:
    return F.coalesce(value.rlike(DIGEST_PATTERN), F.lit(False))


def unit_documents(
    purged: DataFrame, keys: Sequence[str] = ("session_id",), fields: Sequence[str] = ("role", "text"), part_rows: int = PART_ROWS
) -> DataFrame:
    """One canonical JSON array per purged unit (messages in order, fields sorted) and its SHA-256.

    A unit of more than `part_rows` messages becomes documents of at most so many, with their `part`, and a list of the parts'
    digests is the document of the unit itself (`part` null); its digest is still that of the whole array. No task gathers more than
    two such parts of a unit.
    """
    names = {"text": "content"}
    columns = sorted((names.get(f, f), f) for f in fields)
    unit = [*keys, "unit_id"]
    message = F.struct(F.col("pos").alias("_pos"), *[F.col(f).alias(n) for n, f in columns])
    blocks = purged.groupBy(*unit, F.floor(F.col("pos") / part_rows).alias("_block")).agg(F.array_sort(F.collect_list(message)).alias("_rows"))
    as_json = lambda rows: F.to_json(F.transform(rows, lambda m: F.struct(*[m[n].alias(n) for n, _ in columns])), {"ignoreNullFields": "false"})
    # a unit lies in one run of positions: at most its first and last block are not full, and only those are gathered whole
    part = F.struct("_block", F.when(F.size("_rows") < part_rows, F.col("_rows")).alias("rows"))
    found = blocks.groupBy(*unit).agg(F.array_sort(F.collect_list(part)).alias("_parts"), F.sum(F.size("_rows")).alias("_n"), F.max(F.when(F.size("_rows") == part_rows, F.col("_rows"))).alias("_full"))
    whole = F.when(F.size("_parts") == 1, F.coalesce(F.get("_parts", F.lit(0))["rows"], F.col("_full"))).otherwise(F.flatten(F.transform("_parts", lambda p: p["rows"])))
    small = found.filter(F.col("_n") <= part_rows).select(*unit, F.lit(None).cast("bigint").alias("part"), as_json(whole).alias("unit"))
    large = found.filter(F.col("_n") > part_rows).select(*unit)
    parts = blocks.join(large, unit, "left_semi").select(*unit, F.col("_block").cast("bigint").alias("part"), as_json(F.col("_rows")).alias("unit"))
    digest = F.sha2("unit", 256).alias("digest")
    return small.select("*", digest).unionByName(_with_listings(parts.select("*", digest), unit))


def _with_listings(parts: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Part documents, and behind the last of a unit their list with the digest of the whole unit, hashed part by part."""
    shape = T.StructType([T.StructField(f.name, f.dataType) for f in parts.schema])  # a listing has no part

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, digests, running = None, [], None

        def listing() -> pa.RecordBatch:
            running.update(b"]")
            row = dict(zip(unit, keys)) | {"part": None, "unit": json.dumps([{"part": d} for d in digests], separators=(",", ":")), "digest": running.hexdigest()}
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            schema = batch.schema
            for row in batch.to_pylist():
                own = tuple(row[k] for k in unit)
                if own != keys:
                    if running:
                        yield listing()
                    keys, digests, running = own, [], hashlib.sha256(b"[")
                else:
                    running.update(b",")
                digests.append(row["digest"])
                running.update(row["unit"][1:-1].encode())
            yield batch
        if running:
            yield listing()

    return parts.repartition(*unit).sortWithinPartitions(*unit, "part").mapInArrow(listed, shape)


def session_digests(
    documents: DataFrame, keys: Sequence[str] = ("session_id",), part_units: int = BLOCK_ROWS
) -> DataFrame:
    """Digest list of a session for its audit row, in unit order, in parts of at most part_units units."""
    documents = documents.filter("part IS NULL") if "part" in documents.columns else documents
    item = F.struct("unit_id", "digest")
    part = F.floor(F.col("unit_id") / part_units).cast("bigint").alias("part")
    return (
        documents.groupBy(*keys, part)
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
        .select(*keys, "part", F.transform("_items", lambda i: i["digest"]).alias("purged_hashes"))
    )


def whole_lists(digests: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Digest list of a session in one row, put together from all its parts."""
    part = F.struct("part", "purged_hashes")
    return (
        digests.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(part)).alias("_parts"))
        .select(*keys, F.flatten(F.transform("_parts", lambda p: p["purged_hashes"])).alias("purged_hashes"))
    )


def new_units(documents: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Distinct units the store does not hold yet."""
    distinct = documents.select("digest", "unit").dropDuplicates(["digest"])
    return distinct if stored is None else distinct.join(stored.select("digest"), "digest", "left_anti")


def append_units(documents: DataFrame, path: str, stored: DataFrame | None = None, *, writer: str = "0", batch: int = 0) -> None:
    """Write units the store does not hold, in shards by the first two hex digits of their digest, with a Bloom filter on the digest
    in every file, so that lookups open few shards and skip most row groups of those. A shard is written by one task, so a batch has
    at most 256 files, and filters are as large as their digests need.

    Each batch of a writer has folders of its own and replaces them when it is written again. Writers that store one unit at the
    same time store it twice; `read_units` gives it once.
    """
    fresh = new_units(documents, stored).withColumns({"writer": F.lit(writer), "batch": F.lit(batch), "shard": F.substring("digest", 1, 2)})
    out = fresh.repartition(SHARDS, "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#digest", "true")
    out = out.option("parquet.bloom.filter.adaptive.enabled", "true")
    out.partitionBy("writer", "batch", "shard").parquet(path)


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """Each stored unit once."""
    rows = spark.read.schema("digest STRING, unit STRING, writer STRING, batch BIGINT, shard STRING").parquet(path)
    return rows.select("digest", "unit", "shard").dropDuplicates(["digest"])


def rehydrate(digests: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored unit per digest with a status: found, unknown, or invalid (not a digest at all).

    Popular digests make this join skewed; it is an equi-join that adaptive execution can split.
    """
    checked = digests.withColumn("_valid", is_digest(F.col("digest")))
    known = stored.select(F.col("digest").alias("_known"), "unit")
    joined = checked.join(known, checked["_valid"] & (checked["digest"] == known["_known"]), "left")
    status = (
        F.when(~F.col("_valid"), "invalid").when(F.col("_known").isNull(), "unknown").otherwise("found")
    )
    return joined.withColumn("status", status).drop("_valid", "_known")
