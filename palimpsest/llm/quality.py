"""Quality rules: a base rule on counts, then boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import boosting
from palimpsest.llm.textarrays import chunks
from palimpsest.llm.textstats import COUNTS, FEATURES, statistics


@dataclass(frozen=True)
class QualityConfig:
    """`sample`: most labelled rows that the trees are trained on, the first by a hash of the id. `least`: probability of
    good quality from which a document is kept; below one half, so that a doubtful document stays."""

    sample: int = 16_384
    least: float = 0.3
    least_words: int = 20
    most_repeated_percent: int = 30
    boost: boosting.BoostConfig = field(default_factory=boosting.BoostConfig)


_SHAPE = "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, base_failed: boolean, score: double, kept: boolean>"


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def document_features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([row for texts in chunks(batch) for row in statistics(texts)[1].tolist()], pa.list_(pa.float64()))


def trained(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> boosting.Trees:
    """Trees for P(label = 1) from at most `cfg.sample` labelled documents.

    Rows with a null id or label are not used. Without labels of both kinds the trees are a constant: all labels say the same,
    or, with no label at all, every document is good. Only numbers of the sample reach the driver.
    """
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
        .dropna()
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(cfg.sample)
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.distinct()), "id")
    rows = rows.groupBy("id", "label").agg(F.max("text").alias("text"))  # a row per id and label, however often an id repeats
    got = rows.select(document_features("text").alias("x"), F.col("label").cast("int").alias("label")).toArrow()
    if not got.num_rows:
        return boosting.constant(1.0)
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(got.num_rows, len(FEATURES))
    return boosting.train(x, got.column("label").to_numpy(), list(FEATURES.values()), cfg.boost)


def verdict(text: Column, trees: boosting.Trees, cfg: QualityConfig = QualityConfig()) -> Column:
    """Struct of the counts, `base_failed`, `score` and `kept` for whole texts; null and empty texts have no words and fail."""

    @F.arrow_udf(_SHAPE)
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [statistics(texts) for texts in chunks(batch)]
            counts = np.concatenate([c for c, _ in parts] or [np.zeros((0, len(COUNTS)), np.int64)])
            x = np.concatenate([f for _, f in parts] or [np.zeros((0, len(FEATURES)))])
            words, repeated = counts[:, 0], counts[:, COUNTS.index("n_repeat_words")]
            failed = (words < cfg.least_words) | (100 * repeated > cfg.most_repeated_percent * words)
            score = trees.probability(x)
            yield pa.StructArray.from_arrays(
                [*map(pa.array, counts.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= cfg.least))],
                [*COUNTS, "base_failed", "score", "kept"],
            )

    return judge.asNondeterministic()(text)


def judged(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs` plus the struct `quality`; one that `docs` has under this name is replaced.

    Documents are judged one by one where they lie, without a shuffle: repeated rows get equal verdicts.
    """
    trees = trained(docs, labels, cfg, id_col, text_col)
    return docs.withColumn("quality", verdict(F.col(text_col), trees, cfg))
