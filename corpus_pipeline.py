"""The training-text pipeline: quality rules, exact and near deduplication, a mix of sources, and piece ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. `run` writes
every stage's rows as Parquet in the shared folder and reads them again, so that a stage runs once and a lost executor costs
tasks, not stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import grace, minhash, mixing, pieces, quality
from palimpsest.llm.queries import PIECES
from palimpsest.llm.tables import table
from palimpsest.operators.lineage import checkpoint_root, cut
from palimpsest.shipping import ship


def _rows(docs: DataFrame) -> DataFrame:
    """Each row whole, as `whole`, next to its `id` and `text`: what stages add can not meet a column of the documents."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "doc_id", "text")


def _one_of_each(docs: DataFrame, verdicts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`docs` but the rows that `verdicts`, called with numbers of rows (`row`) and texts, does not keep.

    Rows are told apart by id and digest of the text. Where every id is there and has one text, the id is the number. Else
    rows are numbered in the order of id, null ids last, and digest, so that the smallest id stays first. Of rows that repeat
    both, one stays, the first by a digest of all its columns.
    """
    text = [F.col("doc_id").cast("string"), F.col("text")]
    spelt = [*[F.coalesce(F.length(c), F.lit(-1)) for c in text], *[F.coalesce(c, F.lit("")) for c in text]]
    own = _rows(docs).withColumn("key", F.sha2(F.concat_ws(":", *spelt), 256))
    keys = cut(own.groupBy("doc_id", "key").agg(F.count("*").alias("copies")))
    if keys.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty():
        keys = keys.withColumn("row", F.col("doc_id"))
        rows = own.withColumn("row", F.col("doc_id"))
    else:
        keys = cut(keys.orderBy(F.asc_nulls_last("doc_id"), "key").withColumn("row", F.monotonically_increasing_id()))
        rows = cut(own.join(keys.select("key", "row"), "key"))
    left = rows.join(verdicts(rows.select("row", "text")).filter("NOT kept").select("row").distinct(), "row", "left_anti")
    repeated = keys.filter("copies > 1").select("row")
    if repeated.isEmpty():
        return left.select("whole.*")
    copies = cut(left.join(repeated, "row", "left_semi"))  # cut, so that copies of one row meet after they are merged by task
    one = copies.groupBy("row").agg(F.min_by("whole", F.sha2(F.to_json("whole"), 256)).alias("whole"))
    return left.join(repeated, "row", "left_anti").select("whole").union(one.select("whole")).select("whole.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the trees keep, with all their columns and however often they repeat.

    Null and empty texts have no words and go; a null id has no label and is judged like any; long texts are judged whole."""
    ship(spark)
    judged = quality.judged(_rows(docs), table(spark, sf_dir, "labels"))
    return judged.filter("quality.kept").select("whole.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest before white space goes, then the smallest id, null ids last.

    Null and empty texts are equal; texts are compared whole."""
    ship(spark)
    return _one_of_each(docs, lambda rows: grace.exact_duplicates(rows, id_col="row"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a similarity of 0.8 or more: the smallest id, null ids last.

    A null text or one without words is like no other and stays; sets are those of whole texts."""
    ship(spark)
    return _one_of_each(docs, lambda rows: minhash.near_duplicates(rows, minhash.NearConfig(words=5, percent=80), id_col="row"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, all columns as they are.

    Null and empty texts have no words but are taken like others; rows that repeat id and text share their draw."""
    ship(spark)
    return mixing.emitted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every copy: doc_id, n_tokens, tokens. Null and empty texts have no tokens; no other column is read."""
    ship(spark)
    read = pieces.encoded_documents(docs.select("doc_id", "text"), pieces.read_pieces(PIECES))
    return read.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens")


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("mix", mix),
    ("encode", encode),
]

#: Trees and piece search are no SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`."""
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
