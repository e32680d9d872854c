"""Language identification with string kernels.

Two texts are compared by the n-grams of one to three characters that both contain: k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|).
A Nystroem map over landmark texts and a one-versus-rest kernel ridge regression turn the kernel values of a text with the
landmarks into one score per language; scoring a batch is two matrix products.

Characters are read as 64 symbols: a-z, 36 classes of all other letters (neighbours in Unicode differ), and one for the rest.
So the set of possible n-grams is fixed, and the presence of all n-grams of a whole text is one array of flags.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.tables import id_remainder
from palimpsest.llm.textarrays import Chunk, chunks
from palimpsest.llm.textstats import DIGIT, kinds

SPACE = 64 + 64**2 + 64**3


@dataclass(frozen=True)
class LanguageConfig:
    """Most labelled rows of the fit, landmarks among them, and the ridge. The rows are shared out evenly over the languages;
    the `languages` most common ones are learned."""

    sample: int = 4096
    landmarks: int = 256
    ridge: float = 1e-2
    languages: int = 256


@lru_cache
def _symbols() -> np.ndarray:
    letter = (kinds() > 0) & (kinds() != DIGIT)
    table = np.where(letter, 27 + np.arange(0x110000) % 36, 0).astype(np.uint32)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


def gram_sets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted n-gram numbers of each text, and whether it has a letter."""
    chunk = Chunk([t.lower() for t in texts])
    s = _symbols()[chunk.codes]
    two = 64 + s[:-1] * 64 + s[1:] if len(s) > 1 else s[:0]
    three = 4160 + (s[:-2] * 64 + s[1:-1]) * 64 + s[2:] if len(s) > 2 else s[:0]
    flags, sets = np.zeros(SPACE, bool), []
    for a, b in zip(chunk.starts.tolist(), chunk.ends.tolist()):
        for grams, n in ((s, 1), (two, 2), (three, 3)):
            flags[grams[a : max(a, b - n + 1)]] = True
        found = np.flatnonzero(flags)
        flags[found] = False
        sets.append(found.astype(np.int32))
    return sets, chunk.count(s > 0) > 0


class Landmarks:
    """Presence of the landmark texts' n-grams, as a matrix; and kernel values of other texts with them."""

    def __init__(self, sets: list[np.ndarray]):
        self.known = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.int32)
        self.place = np.full(SPACE, len(self.known), np.int32)
        self.place[self.known] = np.arange(len(self.known))
        self.rows = np.zeros((len(self.known) + 1, len(sets)), np.float32)
        for k, grams in enumerate(sets):
            self.rows[self.place[grams], k] = 1 / np.sqrt(len(grams))

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values, texts x landmarks; 0 for a text without n-grams. The last column of presence is for unknown ones."""
        presence = np.zeros((len(sets), len(self.rows)), np.float32)
        for k, grams in enumerate(sets):
            if len(grams):
                presence[k, self.place[grams]] = 1 / np.sqrt(len(grams))
        presence[:, -1] = 0
        return presence @ self.rows


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    landmarks: Landmarks
    weights: np.ndarray

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.landmarks.kernel(sets) @ self.weights[:-1] + self.weights[-1]


def _sampled(rows: DataFrame, cfg: LanguageConfig) -> DataFrame:
    """At most `cfg.sample` ids with their language, the same number of each language as far as there are; first by a hash.

    Of more than `cfg.languages` languages those with most rows are learned, equal ones by name; the others are never predicted.
    """
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(cfg.languages)
    sizes = counts.collect()  # at most `cfg.languages` rows
    quota = max(1, cfg.sample // max(1, len(sizes)))
    known = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, (4 * quota + 100) / r["n"])) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    return rows.join(F.broadcast(known), "lang").filter(draw < F.col("share")).drop("share").withColumn("place", first).filter(F.col("place") <= quota)


def trained(docs: DataFrame, cfg: LanguageConfig = LanguageConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 3) -> LanguageModel:
    """The model, from rows with id, language and crc32(id) mod `held_out` other than 1. The sample's n-grams stay on the
    executors except those of the landmarks; kernel values of the sample come back."""
    spark = docs.sparkSession
    named = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).dropna().filter(id_remainder("id", held_out) != 1)
    chosen = F.broadcast(_sampled(named, cfg).dropDuplicates(["id"]))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    rows = rows.groupBy("id", "lang", "place").agg(F.max("text").alias("text"))  # a row per id, however often it repeats

    @F.arrow_udf("array<int>")
    def grams(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([s for texts in chunks(batch) for s in gram_sets(texts)[0]], pa.list_(pa.int32()))

    languages = [r["lang"] for r in rows.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return LanguageModel([], Landmarks([]), np.zeros((0, 0)))
    each = max(1, cfg.landmarks // len(languages))
    marks = [r["g"] for r in rows.filter(F.col("place") <= each).orderBy("lang", "place").select(grams("text").alias("g")).collect() if r["g"]]
    landmarks = Landmarks([np.array(m, np.int32) for m in marks])
    shared = spark.sparkContext.broadcast(landmarks)

    @F.arrow_udf("array<float>")
    def kernels(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([k for texts in chunks(batch) for k in shared.value.kernel(gram_sets(texts)[0])], pa.list_(pa.float32()))

    got = rows.select("lang", kernels("text").alias("k")).toArrow()
    k = got.column("k").combine_chunks().flatten().to_numpy().reshape(got.num_rows, len(marks)).astype(float)
    y = np.array([[1.0 if lang == c else -1.0 for c in languages] for lang in got.column("lang").to_pylist()])
    values, vectors = np.linalg.eigh(landmarks.kernel([np.array(m, np.int32) for m in marks]).astype(float))
    strong = values > 1e-6 * values.max()
    project = vectors[:, strong] / np.sqrt(values[strong])
    phi = np.column_stack([k @ project, np.ones(len(k))])
    w = np.linalg.solve(phi.T @ phi + cfg.ridge * len(k) * 1e-2 * np.eye(phi.shape[1]), phi.T @ y)
    return LanguageModel(languages, landmarks, np.vstack([project @ w[:-1], w[-1:]]))


def identified(docs: DataFrame, cfg: LanguageConfig = LanguageConfig(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 3) -> DataFrame:
    """All columns of `docs` plus the struct `language`: `held_out`, `lang_pred`, `score` from 0 to 1.

    Predictions read the whole text alone. A null or empty text, or one without a letter, is `und` with score 0, as is every
    text if no row can be learned from; a tie goes to the first language by name. A row with a null id is never learned from
    and not held out. Repeated ids are drawn once for the sample. A column `language` of `docs` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, cfg, id_col, text_col, lang_col, held_out))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for batch in batches:
            names, values = [], []
            for texts in chunks(batch):
                sets, lettered = gram_sets(texts)
                if not model.languages:
                    lettered[:] = False
                    scores = np.zeros((len(texts), 1))
                else:
                    scores = model.scores(sets)
                best = scores.argmax(1)
                names += [model.languages[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist())]
                values.append(np.where(lettered, np.clip((scores.max(1) + 1) / 2, 0, 1), 0.0))
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(values or [np.zeros(0)]))], ["lang_pred", "score"])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "language"])
    held = F.coalesce(id_remainder("id", held_out) == 1, F.lit(False))
    return (
        docs.select(row.alias("row"), F.col(id_col).alias("id"), predict.asNondeterministic()(F.col(text_col)).alias("p"))
        .select("row.*", F.struct(held.alias("held_out"), "p.lang_pred", "p.score").alias("language"))
    )
