"""Mixing sources to target weights, in built-in expressions.

Word counts are summed per source, the sums are shared out by weight with a ceiling per source, and each document is
emitted floor(rate) times plus once more if a hash of its id falls below the fraction of the rate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.lineage import cut

#: Sources of a mix whose table may be broadcast; about 100 bytes each.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class MixConfig:
    """Weights by the rank of a source, repeated; the most times a source may be repeated; seed of the extra copies."""

    weights: tuple[int, ...] = (5, 2, 1)
    ceiling: int = 3
    seed: str = "mix"


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from id and text: 60 bits of md5. Rows that share an id, or have none, draw by their texts."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    hashed = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(id.cast("string"), F.lit("")), digest).cast("binary"))
    return F.conv(F.substring(hashed, 1, 15), 16, 10).cast("long").cast("double") / F.lit(float(1 << 60))


def ranked(sources: DataFrame, per_part: int = 10_000) -> DataFrame:
    """`sources` with `place`: 0, 1, ... in the order of (`missing`, `source`).

    Ranges of the order are numbered on their own and shifted by the sizes of those before, so no task sees all sources.
    """
    parts = max(1, -(-sources.count() // per_part))
    ranges = cut(
        sources.repartitionByRange(parts, "missing", "source").withColumn("part", F.spark_partition_id())
    )
    sizes = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.alias("a").join(sizes.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(
        F.coalesce(F.sum("b.n"), F.lit(0)).alias("before")
    ) if parts > 1 else sizes.select("part", F.lit(0).alias("before"))
    inside = Window.partitionBy("part").orderBy("missing", "source")
    return ranges.join(before, "part").withColumn("place", F.row_number().over(inside) - 1 + F.col("before")).drop("part", "before")


def source_targets(sized: DataFrame, cfg: MixConfig = MixConfig()) -> DataFrame:
    """`missing`, `source`, `source_size`, `target` for documents with `source` and `size`.

    Sources in code point order, null last, take the weights in turn. All words are shared by weight; a source stops at
    `ceiling` times its size, and what it leaves is shared again among the others until none is above. Only sums leave the
    executors.
    """
    sums = sized.groupBy(F.col("source").isNull().alias("missing"), "source").agg(F.sum("size").alias("source_size"))
    weights = F.array(*map(F.lit, cfg.weights))
    table = cut(
        ranked(sums).withColumn("weight", F.element_at(weights, (F.col("place") % len(cfg.weights) + 1).cast("int")))
    )
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    most = F.col("source_size") * cfg.ceiling
    left, weight, full = total, None, F.lit(False)
    while True:
        held = table.agg(
            F.coalesce(F.sum(F.when(full, most)), F.lit(0)).alias("given"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight"),
            F.count(F.when(full, 1)).alias("n"),
        ).first()
        left, weight = total - held["given"], held["weight"]
        share = F.col("weight") * F.lit(float(left)) / F.lit(float(weight or 1))
        more = full | (share > most)
        if not weight or not table.filter(more & ~full).limit(1).count():
            return table.select("missing", "source", "source_size", F.when(full, most.cast("double")).otherwise(share).alias("target"))
        full = more


def mixed(docs: DataFrame, cfg: MixConfig = MixConfig(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All columns of `docs` plus a struct `mix`: `size`, `source_size`, `target`, `copies`.

    The rate of a source is target / source_size; a source without words has rate 0. A row draws by its id and text:
    only rows that repeat both share a draw. Null and empty texts have size 0. Columns of `docs` keep their names and values; one
    named `mix` is replaced.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "mix"])
    own = docs.select(row.alias("row"))
    sized = own.select(
        "row",
        F.col("row").getField(source_col).alias("source"),
        word_count(F.col("row").getField(text_col)).alias("size"),
    )
    targets = cut(source_targets(sized, cfg))
    few = targets.count() <= BROADCAST_SOURCES
    targets = targets.withColumnsRenamed({"source": "s", "missing": "m"})
    joined = sized.join(
        F.broadcast(targets) if few else targets,
        F.col("source").isNull().eqNullSafe(F.col("m")) & (F.coalesce("source", F.lit("")) == F.coalesce("s", F.lit(""))),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    id = F.col("row").getField(id_col)
    copies = F.floor(rate) + (unit_hash(id, F.col("row").getField(text_col), cfg.seed) < rate - F.floor(rate)).cast("long")
    return joined.select("row.*", F.struct("size", "source_size", "target", copies.cast("long").alias("copies")).alias("mix"))


def emitted(docs: DataFrame, cfg: MixConfig = MixConfig(), **columns: str) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, same columns, also one named `mix`."""
    names = {k: columns.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), *[F.col(f"`{v}`").alias(k) for k, v in names.items()])
    taken = mixed(whole, cfg, **{k: k for k in names}).select("whole", F.col("mix.copies").alias("copies"))
    return taken.filter("copies > 0").select("whole", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("whole.*")
