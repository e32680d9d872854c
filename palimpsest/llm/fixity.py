"""Merkle fixity audit of archive replicas, in built-in expressions.

Records of archive files have an offset and a digest. Ranges of offsets hash the records that start in them, in order; above
them every node hashes its children by name: groups of ranges, files, and groups of files. Equal roots prove equal replicas.
Where roots differ, only children of differing nodes are compared, level by level, down to the records.

A node is named by its path: `/`, digits of the file's own hash, the file, digits of the range number. A parent's name is the
path without its last part, so all levels are made alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.lineage import cut


@dataclass(frozen=True)
class FixityConfig:
    """Bytes of a range; hexadecimal digits give every node above a range or file group 16 children. Files of a group: about
    this many."""

    range_bytes: int = 1 << 16
    group_files: int = 16


def laid_out(records: DataFrame, file: Column, order: list[str], length: Column) -> DataFrame:
    """`records` with `file`, `offset`, `length`: records of a file follow each other in the given order.

    The running sum sees one file at a time; archive files are bounded by whoever cuts them, here by `file`.
    """
    before = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumns({"file": file, "length": length.cast("long")}).withColumn(
        "offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    )


def _digits(number: Column, width: int) -> Column:
    """/d/d/...: hexadecimal digits of a number as path parts."""
    return F.regexp_replace(F.lpad(F.lower(F.hex(number)), width, "0"), "(.)", "/$1")


def depth_of(replicas: list[DataFrame], cfg: FixityConfig) -> tuple[int, int]:
    """Digits of file groups and of range numbers, the same for all replicas."""
    files, last = 1, 0
    for records in replicas:
        got = records.agg(F.approx_count_distinct("file").alias("files"), F.max("offset").alias("last")).first()
        files, last = max(files, got["files"]), max(last, got["last"] or 0)
    return max(0, math.ceil(math.log(files / cfg.group_files, 16))) if files > cfg.group_files else 0, max(
        1, len(f"{last // cfg.range_bytes:x}")
    )


def tree(records: DataFrame, depth: tuple[int, int], cfg: FixityConfig = FixityConfig()) -> list[DataFrame]:
    """Levels of a replica's tree from the root down, each `path`, `parent`, `digest`; the last is the records themselves.

    `records` has `file`, `offset`, `length`, `digest`. A file name must not hold a slash in its last part; a null name or
    offset is an empty name or 0. A node's children are at most 16, the files of a group or the records of one range, so no
    node gathers an unbounded list as long as different records have a length.
    """
    file, offset = F.coalesce(F.replace("file", F.lit("/"), F.lit("|")), F.lit("")), F.coalesce("offset", F.lit(0))
    groups, ranges = depth
    shelf = F.regexp_replace(F.substring(F.sha2(file.cast("binary"), 256), 1, groups), "(.)", "/$1") if groups else F.lit("")
    parent = F.concat(shelf, F.lit("/"), file, _digits(F.floor(offset / cfg.range_bytes).cast("long"), ranges))
    name = F.lpad(offset.cast("string"), 20, "0")
    content = F.concat_ws(":", F.coalesce("length", F.lit(-1)).cast("string"), F.coalesce("digest", F.lit("")))
    own = records.select(
        F.concat(parent, F.lit("/"), name).alias("path"), parent.alias("parent"), content.alias("content"), "file", "offset", F.col("digest").alias("record_digest")
    )
    # records that repeat in every respect are one leaf that knows how many they are
    own = own.groupBy(*own.columns).agg(F.count("*").alias("copies"))
    counted = F.when(F.col("copies") == 1, F.col("content")).otherwise(F.concat_ws(" x ", "content", F.col("copies").cast("string")))
    level = cut(own.select("path", "parent", F.sha2(counted.cast("binary"), 256).alias("digest"), "file", "offset", "record_digest", "copies"))
    levels = [level]
    for _ in range(groups + 1 + ranges):
        path = F.col("path")
        children = F.array_sort(F.collect_list(F.concat_ws("=", F.regexp_extract("path", "[^/]*$", 0), "digest")))
        level = cut(
            level.groupBy(F.col("parent").alias("path"))
            .agg(F.sha2(F.array_join(children, "\n").cast("binary"), 256).alias("digest"))
            .withColumn("parent", F.regexp_replace(path, "/[^/]*$", ""))
        )
        levels.append(level)
    return levels[::-1]


def faults(expected: DataFrame, found: DataFrame, cfg: FixityConfig = FixityConfig()) -> DataFrame:
    """Records that differ between two replicas: `file`, `offset`, `status`, `expected_digest`, `found_digest`.

    `status` is `altered`, `missing` (only expected) or `extra` (only found). Two empty replicas have no faults. Records that
    share file and offset are told apart by their digests: each that only one side has is a fault of its own. A record that one
    side has more often is `missing` or `extra`, with both digests.
    """
    depth = depth_of([expected, found], cfg)
    ours, theirs = tree(expected, depth, cfg), tree(found, depth, cfg)
    open_nodes: DataFrame | None = None
    for a, b in zip(ours[:-1], theirs[:-1]):
        if open_nodes is not None:
            a, b = (x.join(open_nodes.withColumnRenamed("path", "parent"), "parent", "left_semi") for x in (a, b))
        both = a.select("path", F.col("digest").alias("x")).join(b.select("path", F.col("digest").alias("y")), "path", "full")
        open_nodes = cut(both.filter(~F.col("x").eqNullSafe(F.col("y"))).select("path"))
    a, b = (x.join(open_nodes.withColumnRenamed("path", "parent"), "parent", "left_semi") for x in (ours[-1], theirs[-1]))
    only_a, only_b = (
        x.join(y.select("path", "digest"), ["path", "digest"], "left_anti").dropDuplicates(["path", "digest"]) for x, y in ((a, b), (b, a))
    )
    both = only_a.select("path", "file", "offset", F.col("record_digest").alias("expected_digest"), F.col("copies").alias("x")).join(
        only_b.select("path", F.col("file").alias("f"), F.col("offset").alias("o"), F.col("record_digest").alias("found_digest"), F.col("copies").alias("y")),
        "path",
        "full",
    )
    status = F.when(F.col("x").isNull(), "extra").when(F.col("y").isNull(), "missing")
    more = F.when(F.col("x") > F.col("y"), "missing").otherwise("extra")
    status = status.when(F.col("expected_digest").eqNullSafe(F.col("found_digest")) & (F.col("x") != F.col("y")), more).otherwise("altered")
    return both.select(
        F.coalesce("file", "f").alias("file"), F.coalesce("offset", "o").alias("offset"), status.alias("status"), "expected_digest", "found_digest"
    )
