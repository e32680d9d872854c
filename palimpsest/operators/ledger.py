"""Hash-chained ledgers over the audit log.

A chain is sequential by nature: every hash needs the one before it. Each deployment has one chain, whatever its length; it
is streamed through one task in Arrow batches. A caller with very busy deployments can cut chains into segments by a column
of the data, such as the day. Segments are hashed in parallel and tied together by a list of sealed heads, a chain of its
own over head, row count and ends of every segment, and are only ever verified against that list.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.config import BLOCK_ROWS
from palimpsest.dims import COEFFICIENT_VERSION, grid_factor
from palimpsest.functions.energy import BOUNDS, saved_columns
from palimpsest.operators.sequence import Layout

# Start of a chain, and the hashed fields in the sorted order of their names.
GENESIS = "GENESIS"
SCHEMA_NAME = "carbon_ledger/1"


def link_hash(prev_hash: Column) -> Column:
    """SHA-256 of the compact JSON of the measured fields and the previous hash, keys sorted."""
    row = F.struct(
        F.col("model").alias("model"),
        prev_hash.alias("prev_hash"),
        F.col("tokens_after").alias("tokens_after"),
        F.col("tokens_before").alias("tokens_before"),
        F.col("ts").alias("ts"),
    )
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def _canonical(model, prev_hash, tokens_after, tokens_before, ts) -> bytes:
    row = {"model": model, "prev_hash": prev_hash, "tokens_after": tokens_after, "tokens_before": tokens_before, "ts": ts}
    return json.dumps(row, separators=(",", ":"), ensure_ascii=False).encode()


def chain(audit: DataFrame, keys: Sequence[str] = ("deployment",), *, segment: Column | None = None, also: Sequence[str] = ()) -> DataFrame:
    """Add segment, prev_hash and hash. `seq` is unique per key; `segment` grows with it, and is 0 for one chain per key. Columns
    in `also` are kept but not hashed.

    An optional column `resume` holds the hash after which the chain continues. The hash of a row feeds the next one, which no
    built-in window can express; rows are streamed in order in Arrow batches, so a task holds one batch and one hash.
    """
    segmented = audit.withColumn("segment", (F.lit(0) if segment is None else segment).cast("bigint"))
    cells = [*keys, "segment"]
    resume = F.col("resume") if "resume" in audit.columns else F.lit(None).cast("string")
    narrow = segmented.select(*cells, "seq", "ts", "model", "tokens_before", "tokens_after", *also, resume.alias("resume"))

    def link(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev = None
        for batch in batches:
            if prev is None:
                prev = batch.column("resume")[0].as_py() or GENESIS
            rows = zip(*(batch.column(c).to_pylist() for c in ("model", "tokens_after", "tokens_before", "ts")))
            before, after = [], []
            for model, tokens_after, tokens_before, ts in rows:
                before.append(prev)
                prev = hashlib.sha256(_canonical(model, prev, tokens_after, tokens_before, ts)).hexdigest()
                after.append(prev)
            kept = [n for n in batch.schema.names if n != "resume"]
            columns = [batch.column(n) for n in kept] + [pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "prev_hash", "hash"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields if f.name != "resume")
    return (
        narrow.repartition(*cells)
        .sortWithinPartitions(*cells, "seq")
        .groupBy(*cells)
        .applyInArrow(link, f"{types}, prev_hash string, hash string")
    )


def segment_heads(chained: DataFrame, keys: Sequence[str] = ("deployment",)) -> DataFrame:
    """One row per segment: its last hash, rows, and first and last sequence number."""
    return chained.groupBy(*keys, "segment").agg(
        F.max_by("hash", "seq").alias("segment_head"),
        F.count(F.lit(1)).alias("rows_in"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )


def _seal_text(prev: Column) -> Column:
    return F.concat_ws("|", prev, "segment", "rows_in", "first_seq", "last_seq", "segment_head")


def seal(heads: DataFrame, keys: Sequence[str] = ("deployment",)) -> DataFrame:
    """The heads with `prev_seal` and `seal`: a chain over the segments of a key, in order. Stored next to the rows."""
    named = heads.withColumn("_text", _seal_text(F.lit("")))

    def link(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev = GENESIS
        for batch in batches:
            before, after = [], []
            for text in batch.column("_text").to_pylist():
                before.append(prev)
                prev = hashlib.sha256((prev + text).encode()).hexdigest()
                after.append(prev)
            kept = [n for n in batch.schema.names if n != "_text"]
            columns = [batch.column(n) for n in kept] + [pa.array(before, pa.string()), pa.array(after, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "prev_seal", "seal"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in heads.schema.fields)
    return (
        named.repartition(*keys).sortWithinPartitions(*keys, "segment").groupBy(*keys).applyInArrow(link, f"{types}, prev_seal string, seal string")
    )


def chain_heads(sealed: DataFrame, keys: Sequence[str] = ("deployment",)) -> DataFrame:
    """Per key: segments, rows and the last seal."""
    return sealed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("segments"), F.sum("rows_in").alias("chain_rows"), F.max_by("seal", "segment").alias("chain_head")
    )


def recheck(chained: DataFrame, keys: Sequence[str] = ("deployment",), *, segmented: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`broken` per row: wrong hash, or a previous hash that is not that of the row before.

    Each row is held against its stored predecessor, so nothing is folded: one long chain is checked in blocks. With
    `segmented`, the first row of a segment follows `GENESIS`.
    """
    cells = [*keys, "segment"] if segmented else list(keys)
    layout = Layout(cells, "seq", block_rows)
    rows = layout.carry(layout.split(chained), last={"_hash_before": F.col("hash")})
    expected = F.coalesce(layout.running_last(F.col("hash"), F.col("_hash_before"), inclusive=False), F.lit(GENESIS))
    good = F.col("prev_hash").eqNullSafe(F.col("_expected")) & F.col("hash").eqNullSafe(link_hash(F.col("prev_hash")))
    return rows.withColumn("_expected", expected).withColumn("broken", ~good).drop("_expected", "_hash_before", "_block")


def broken_seals(chained: DataFrame, sealed: DataFrame, keys: Sequence[str] = ("deployment",)) -> DataFrame:
    """Per key the first sequence number where rows and sealed heads disagree, or the list itself is broken."""
    w = Window.partitionBy(*keys).orderBy("segment")
    listed = sealed.withColumn("_expected", F.coalesce(F.lag("seal").over(w), F.lit(GENESIS))).select(
        *keys,
        "segment",
        F.struct("segment_head", "rows_in", "first_seq", "last_seq").alias("stored"),
        (~(F.col("prev_seal").eqNullSafe(F.col("_expected")) & F.col("seal").eqNullSafe(F.sha2(F.concat(F.col("prev_seal"), _seal_text(F.lit(""))), 256)))).alias("_cut"),
    )
    found = segment_heads(chained, keys).select(*keys, "segment", F.struct("segment_head", "rows_in", "first_seq", "last_seq").alias("found"))
    bad = listed.join(found, [*keys, "segment"], "full").filter(F.coalesce("_cut", F.lit(True)) | ~F.col("stored").eqNullSafe(F.col("found")))
    return bad.groupBy(*keys).agg(F.min(F.coalesce(F.least("stored.first_seq", "found.first_seq"), "stored.first_seq", "found.first_seq")).alias("_at_seal"))


def verify(chained: DataFrame, keys: Sequence[str] = ("deployment",), *, sealed: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per key: whether the chain holds, the first broken sequence number, the last hash, and the rows.

    Without `sealed` a key is one chain over all its rows, and segments do not pass. With the stored list of sealed heads,
    a segment that was deleted, cut at its end, exchanged or added is found, also if no row of it is left.
    """
    rows = recheck(chained, keys, segmented=sealed is not None, block_rows=block_rows).groupBy(*keys).agg(
        F.min(F.when(F.col("broken"), F.col("seq"))).alias("first_broken"),
        F.max_by("hash", "seq").alias("last_hash"),
        F.count(F.lit(1)).alias("requests"),
    )
    if sealed is not None:
        rows = rows.join(broken_seals(chained, sealed, keys), list(keys), "full").withColumns(
            {"first_broken": F.least("first_broken", "_at_seal"), "requests": F.coalesce("requests", F.lit(0))}
        )
    return rows.select(*keys, F.col("first_broken").isNull().alias("ok"), "first_broken", "last_hash", "requests")


def build_ledger(chained: DataFrame, keys: Sequence[str] = ("deployment",), *, sealed: DataFrame | None = None, grid: str = "world",
                 price_in: float | None = None, period: str | None = None) -> DataFrame:
    """One ledger row per key. A broken chain raises instead of giving a ledger.

    `chain_head` is the last hash, or the last seal if the chain is kept in segments with a list of `sealed` heads.
    """
    factor = grid_factor(grid)
    checked = recheck(chained, keys, segmented=sealed is not None)
    sums = checked.groupBy(*keys).agg(
        F.min(F.when(F.col("broken"), F.col("seq"))).alias("_at"),
        F.count(F.lit(1)).alias("requests"),
        F.coalesce(F.sum("tokens_before"), F.lit(0)).alias("before"),
        F.coalesce(F.sum("tokens_after"), F.lit(0)).alias("after"),
        F.max_by("hash", "seq").alias("chain_head"),
    ).withColumn("segments", F.lit(1).cast("bigint"))
    if sealed is not None:
        sums = (
            sums.drop("chain_head", "segments")
            .join(broken_seals(chained, sealed, keys), list(keys), "full")
            .join(chain_heads(sealed, keys).drop("chain_rows"), list(keys), "full")
            .withColumn("_at", F.least("_at", "_at_seal"))
            .drop("_at_seal")
        )
    guarded = sums.withColumn(
        "before",
        F.when(
            F.col("_at").isNotNull(),
            F.raise_error(F.concat(F.lit("audit chain broken at row "), F.col("_at"))).cast("bigint"),
        ).otherwise(F.col("before")),
    )
    saved = F.col("before") - F.col("after")
    percent = F.when(F.col("before") > 0, F.bround(100.0 * (1 - F.col("after") / F.col("before")), 4)).otherwise(0.0)
    usd = F.when(saved > 0, F.bround(saved / 1e6 * price_in, 6)) if price_in else F.lit(None).cast("double")
    return (
        guarded
        .withColumns({"saved": saved, "input_reduction_pct": percent, "usd_input_avoided": usd})
        .withColumns(saved_columns(F.col("saved"), grid))
        .withColumns(
            {
                "schema": F.lit(SCHEMA_NAME),
                "period": F.lit(period).cast("string"),
                "grid": F.lit(grid),
                "grid_g_per_kwh": F.lit(factor),
                "coefficient_version": F.lit(COEFFICIENT_VERSION),
            }
        )
        .drop("_at")
    )


def ledger_documents(ledger: DataFrame) -> DataFrame:
    """Nested form of the ledger rows, as written to JSON."""
    bounds = {n: F.array(*[F.col(f"{n}_{b}") for b in BOUNDS]) for n in ("wh", "gco2e")}
    flat = {f"{n}_{b}" for n in bounds for b in BOUNDS} | {"before", "after", "saved"}
    rest = [c for c in ledger.columns if c not in flat]
    return ledger.select(
        *rest,
        F.struct("before", "after", "saved").alias("tokens"),
        bounds["wh"].alias("wh_avoided"),
        bounds["gco2e"].alias("gco2e_avoided"),
    )


def write_ledger(ledger: DataFrame, path: str) -> None:
    ledger_documents(ledger).write.mode("append").json(path)


def compare_ledgers(stored: DataFrame, rebuilt: DataFrame, keys: Sequence[str] = ("deployment",)) -> DataFrame:
    """Equality of the core fields of a stored ledger and one rebuilt from the audit log."""
    fields = ["before", "after", "input_reduction_pct", "chain_head"]
    left = stored.select(*keys, *[F.col(f).alias(f"_stored_{f}") for f in fields])
    right = rebuilt.select(*keys, *[F.col(f).alias(f"_rebuilt_{f}") for f in fields])
    checks = [F.col(f"_stored_{f}").eqNullSafe(F.col(f"_rebuilt_{f}")).alias(f"{f}_ok") for f in fields]
    every = F.lit(True)
    for f in fields:
        every = every & F.col(f"{f}_ok")
    return left.join(right, list(keys), "full").select(*keys, *checks).withColumn("ok", every)
