"""Toxicity by class-conditional Kneser-Ney models.

Each class has a language model of its labelled texts: lower-cased letters and digits, every other run one space, with marks
before the first and after the last word. A symbol is predicted from the `order` - 1 symbols before it, across the ends of
words, by interpolated modified Kneser-Ney: P(x | context) is the discounted count of context and x over the count of the
context, and the mass of the discounts goes to the next shorter context. Shorter orders count contexts instead of
occurrences: the number of different symbols seen before them. The three discounts of an order and class come from its numbers
of n-grams seen once to four times. A document's score is the difference of its mean log-likelihoods, turned into a probability
by a logistic fit on labelled documents that the counts leave out.

A log-likelihood ratio is a sum over the orders: what the discounts leave to the shorter context, and what a seen n-gram adds
to that. So each n-gram has one number, n-grams that no labelled text holds have 0, and a text's sum needs no search from order
to order. N-grams are told apart by 64-bit hashes of all their symbols. The counts are a shuffled table that grows with the
corpus. Numbers of the most common n-grams are broadcast, as many as the configuration says; in a corpus with more, the rest
meets the table by a join of (text, n-gram), with the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.tables import counted_hint, id_remainder
from palimpsest.llm.textarrays import BASE, U64, Chunk, chunks, hash_spans, span_hash
from palimpsest.llm.textstats import kinds
from palimpsest.operators.lineage import cut

#: The symbols before the first and after the last word of a text.
FIRST, LAST = "\x02", "\x03"

CLASSES = ("toxic", "ordinary")

#: Distinct words that a task merges before it passes their counts on.
MERGE_WORDS = 1 << 20

#: Numbers of documents told apart when the broadcast words are chosen; more count as so many.
DOCUMENTS_TOLD = 1 << 16


@dataclass(frozen=True)
class ToxicityConfig:
    """`slot_bits`: ratios of at most 2^bits n-grams, the most common ones, are broadcast, 12 bytes each; the others are joined.
    `order`: symbols of the longest n-grams. `discount`, `shared`: discount and fixed weight of the lower order of `ratio_tables`,
    which `scored` does not use. `sample`: most labelled documents of the calibration fold, one in
    `fold_of` of the labelled ones, that the logistic fit uses."""

    slot_bits: int = 22
    discount: float = 0.7
    shared: float = 0.98
    sample: int = 16_384
    fold_of: int = 8
    order: int = 5


def word_slots(texts: list[str], bits: int = 64) -> tuple[Chunk, np.ndarray, np.ndarray]:
    """Hash of every word of the texts and the text that holds it; words are lower-cased runs of letters and digits. Words alone, for
    `word_counts`; `scored` reads texts as `Symbols`.

    Hashes are whole for any `bits`, which older callers give."""
    chunk = Chunk([t.lower() for t in texts])
    starts, ends = chunk.spans(kinds()[chunk.codes] > 0)
    return chunk, hash_spans(chunk.codes, starts, ends).view(np.int64), chunk.text_of(starts)


_COUNTS = pa.schema([("word", pa.int64()), ("toxic", pa.int64()), ("ordinary", pa.int64()), ("documents", pa.int64())])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Words and their counts (words x 3), each word once."""
    words, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
    sums = np.zeros((len(words), 3), np.int64)
    np.add.at(sums, at, np.concatenate([c for _, c in parts]))
    return words, sums


def _batches(words: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(words), 1 << 16):
        part = slice(a, a + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(words[part]), *(pa.array(c) for c in sums[part].T.copy())], schema=_COUNTS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, more = [], 0
    for batch in batches:
        labels = np.array([-1 if v is None else v for v in batch.column(1).to_pylist()])
        at = 0
        for texts in chunks(batch.column(0)):
            _, hashes, owner = word_slots(texts)
            own = labels[at : at + len(texts)][owner]
            at += len(texts)
            words, index = np.unique(hashes, return_inverse=True)
            pairs = np.unique(owner * max(1, len(words)) + index) % max(1, len(words))
            held.append((words, np.column_stack([np.bincount(x, minlength=len(words)) for x in (index[own == 1], index[own == 0], pairs)])))
            more += len(words)
            if more > MERGE_WORDS:
                words, sums = _merged(held)
                held, more = [(words, sums)], 0
                if len(words) > MERGE_WORDS:
                    yield from _batches(words, sums)
                    held = []
    if held:
        yield from _batches(*_merged(held))


def word_counts(labelled: DataFrame, cfg: ToxicityConfig) -> DataFrame:
    """Order one, beside `scored`: `word`, tokens in `toxic` and `ordinary` texts, and `documents` with the word, over all rows of (`text`, `label`)."""
    parts = labelled.select("text", "label").mapInArrow(_count, "word long, toxic long, ordinary long, documents long")
    return parts.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("toxic", "ordinary", "documents")])


class Ratios:
    """Log-ratios by word hash; 0 for words that are not held."""

    def __init__(self, words: np.ndarray, values: np.ndarray):
        order = np.argsort(words)
        self.words, self.values = words[order], values[order]

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ratio of each word, and whether it is held."""
        if not len(self.words):
            return np.zeros(len(words), np.float32), np.zeros(len(words), bool)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        held = self.words[at] == words
        return np.where(held, self.values[at], np.float32(0)), held

    def __getitem__(self, words: np.ndarray) -> np.ndarray:
        return self.find(words)[0]


def ratio_tables(counts: DataFrame, cfg: ToxicityConfig) -> tuple[DataFrame | None, DataFrame | None]:
    """Two tables of `word` and `ratio`, log P(word | toxic) - log P(word | ordinary), which is 0 for words of no labelled text.

    The first has the most common words, at most 2^slot_bits: labelled ones, or, if there are other words, all that so many
    documents use. The second has the labelled ones among the others, None without any. Without both classes both are None.
    """
    above = {c: F.greatest(F.col(c) - cfg.discount, F.lit(0.0)) for c in ("toxic", "ordinary")}
    sums = counts.agg(*[F.sum(a).alias(c) for c, a in above.items()], F.sum("documents").alias("documents")).first()
    if not sums["toxic"] or not sums["ordinary"]:
        return None, None
    lower = cfg.shared * F.col("documents") / float(sums["documents"])
    p = {c: (1 - cfg.shared) * a / float(sums[c]) + lower for c, a in above.items()}
    ratios = counts.select("word", "documents", (F.col("toxic") + F.col("ordinary") > 0).alias("labelled"), F.log(p["toxic"] / p["ordinary"]).cast("float").alias("ratio"))
    common, rare = most_common(ratios, cfg)
    labelled = lambda part: None if part is None else part.filter("labelled").select("word", "ratio")
    return (labelled(common) if rare is None else common.select("word", "ratio")), labelled(rare)


def most_common(ratios: DataFrame, cfg: ToxicityConfig) -> tuple[DataFrame, DataFrame | None]:
    """The rows to broadcast, at most 2^slot_bits with the highest `documents`, and the others, None if all fit."""
    told = ratios.groupBy(F.least("documents", F.lit(DOCUMENTS_TOLD)).alias("d")).agg(F.count("*").alias("n")).collect()
    held, least = 0, DOCUMENTS_TOLD + 1
    for d, n in sorted(((r["d"], r["n"]) for r in told), reverse=True):
        held += n
        if held > 1 << cfg.slot_bits:
            common = F.col("documents") >= least
            return ratios.filter(common), ratios.filter(~common)
        least = d
    return ratios, None


class Symbols:
    """Texts as symbols, `order` marks before each: `codes`, the text of each in `owner`; `seen` are the symbols and the mark
    right before them, `sizes` the symbols of each text with its last mark, 0 without words."""

    def __init__(self, texts: list[str], order: int):
        chunk = Chunk([t.lower() for t in texts])
        starts, ends = chunk.spans(kinds()[chunk.codes] > 0)
        owner = chunk.text_of(starts)
        new = np.diff(owner, prepend=-1) > 0
        lengths, marks = ends - starts, np.where(new, order, 0)
        sizes = lengths + 1 + marks
        begin = np.cumsum(sizes) - sizes
        self.order, self.owner = order, np.repeat(owner, sizes)
        self.codes = np.full(int(sizes.sum()), ord(FIRST), np.uint32)
        within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.codes[within + np.repeat(begin + marks, lengths)] = chunk.codes[within + np.repeat(starts, lengths)]
        self.codes[begin + sizes - 1] = np.where(np.diff(owner, append=chunk.n) > 0, ord(LAST), ord(" "))
        inner = np.ones(len(self.codes), bool)
        inner[(begin[new][:, None] + np.arange(order - 1)).ravel()] = False
        self.seen = np.flatnonzero(inner)
        self.sizes = np.bincount(owner, lengths + 1, chunk.n).astype(np.int64)

    def keys(self, at: np.ndarray) -> Iterator[np.ndarray]:
        """Hashes of the n-grams that end at the positions, by order from 1; as `hash_spans` of their symbols."""
        total = np.zeros(len(at), U64)
        with np.errstate(over="ignore"):
            for n in range(1, self.order + 1):
                total = self.codes[at - (n - 1)].astype(U64) + U64(1) + total * BASE
                yield span_hash(total, n).view(np.int64)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """A position in `seen` of every different longest n-gram, and the number of that n-gram for each of `seen`."""
        *_, longest = self.keys(self.seen)
        _, first, index = np.unique(longest, return_index=True, return_inverse=True)
        return self.seen[first], index

    def grams(self, at: np.ndarray) -> np.ndarray:
        return self.codes[at[:, None] + np.arange(1 - self.order, 1)]


def _gram_batches(grams: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(grams), 1 << 16):
        part = np.ascontiguousarray(grams[a : a + (1 << 16)])
        flat = part.tobytes().decode("utf-32-le", "replace")
        strings = [flat[i : i + part.shape[1]] for i in range(0, len(flat), part.shape[1])]
        yield pa.RecordBatch.from_arrays([pa.array(strings), *(pa.array(c) for c in sums[a : a + (1 << 16)].T.copy())], ["gram", *CLASSES])


def _count_grams(order: int):
    def merged(parts):
        grams = np.concatenate([g for g, _ in parts])
        _, first, at = np.unique(hash_spans(grams.ravel(), *(np.arange(len(grams)) * order + d for d in (0, order))), return_index=True, return_inverse=True)
        sums = np.zeros((len(first), 2), np.int64)
        np.add.at(sums, at, np.concatenate([c for _, c in parts]))
        return grams[first], sums

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more = [], 0
        for batch in batches:
            labels = np.array(batch.column(1).to_pylist(), np.int64)
            done = 0
            for texts in chunks(batch.column(0)):
                s = Symbols(texts, order)
                own = labels[done : done + len(texts)][s.owner[s.seen]]
                done += len(texts)
                at, index = s.whole()
                grams = s.grams(at)
                sums = np.column_stack([np.bincount(index[own == k], minlength=len(at)) for k in (1, 0)])
                predicted = grams[:, -1] != ord(FIRST)
                held.append((grams[predicted], sums[predicted]))
                more += len(at)
                if more > MERGE_WORDS:
                    held, more = [merged(held)], 0
                    if len(held[0][0]) > MERGE_WORDS:
                        yield from _gram_batches(*held[0])
                        held = []
        if held:
            yield from _gram_batches(*merged(held))

    return count


def gram_counts(labelled: DataFrame, cfg: ToxicityConfig) -> DataFrame:
    """`gram`, the longest n-grams, and how often `toxic` (1) and `ordinary` (0) texts of (`text`, `label`) hold them."""
    rows = labelled.filter("label IN (0, 1)").select("text", F.col("label").cast("long").alias("label"))
    parts = rows.mapInArrow(_count_grams(cfg.order), "gram string, toxic long, ordinary long")
    return parts.groupBy("gram").agg(*[F.sum(c).alias(c) for c in CLASSES])


def discounts(n: list[int]) -> list[float]:
    """What an n-gram seen once, twice and more often loses, from the numbers of n-grams seen one to four times."""
    n = [max(1, k) for k in n]
    y = n[0] / (n[0] + 2.0 * n[1])
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1), float(i)) for i in (1, 2, 3)]


def gram_ratios(counts: DataFrame, cfg: ToxicityConfig) -> tuple[DataFrame | None, float]:
    """Table of `gram`, `documents` (its count) and `ratio`, and a constant: the log-likelihood ratio of a text is the sum of the
    ratios of all n-grams that end in it or in the mark before it, and the constant for each symbol. Without both classes the table is None."""
    levels = {cfg.order: cut(counts)}
    if not all(levels[cfg.order].agg(*[F.sum(c) for c in CLASSES]).first()):
        return None, 0.0
    for n in range(cfg.order - 1, 0, -1):
        above = levels[n + 1].groupBy(F.expr("substring(gram, 2)").alias("gram"))
        levels[n] = cut(above.agg(*[F.count_if(F.col(c) > 0).alias(c) for c in CLASSES]))
    uniform = F.lit(1.0 / (levels[1].count() + 1))
    shorter = levels[1].select(F.lit("").alias("rest"), *[uniform.alias(f"low_{c}") for c in CLASSES]).limit(1)
    parts, base = [], 0.0
    for n in range(1, cfg.order + 1):
        found = levels[n].agg(*[F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in CLASSES for k in (1, 2, 3, 4)]).first()
        taken = {}
        for c in CLASSES:
            d = discounts([found[f"{c}{k}"] for k in (1, 2, 3, 4)])
            taken[c] = F.when(F.col(c) > 2, d[2]).when(F.col(c) == 2, d[1]).when(F.col(c) == 1, d[0]).otherwise(0.0)
        rows = levels[n].select("gram", *CLASSES, *[taken[c].alias(f"off_{c}") for c in CLASSES],
                                F.substring("gram", 1, n - 1).alias("context"), F.expr("substring(gram, 2)").alias("rest"))
        sums = rows.groupBy("context").agg(F.sum(F.col("toxic") + F.col("ordinary")).alias("documents"),
                                           *[F.sum(c).alias(f"all_{c}") for c in CLASSES], *[F.sum(f"off_{c}").alias(f"mass_{c}") for c in CLASSES])
        left = {c: F.when(F.col(f"all_{c}") > 0, F.col(f"mass_{c}") / F.col(f"all_{c}")).otherwise(1.0) for c in CLASSES}
        sums = cut(sums.select("context", "documents", *[f"all_{c}" for c in CLASSES], *[left[c].alias(f"left_{c}") for c in CLASSES]))
        lower = {c: F.col(f"left_{c}") * F.col(f"low_{c}") for c in CLASSES}
        p = {c: F.when(F.col(f"all_{c}") > 0, (F.col(c) - F.col(f"off_{c}")) / F.col(f"all_{c}")).otherwise(0.0) + lower[c] for c in CLASSES}
        level = cut(rows.join(sums.drop("documents"), "context").join(shorter, "rest").select(
            "gram", (F.col("toxic") + F.col("ordinary")).alias("documents"), *[p[c].alias(c) for c in CLASSES],
            (F.log(p["toxic"] / p["ordinary"]) - F.log(lower["toxic"] / lower["ordinary"])).alias("ratio")))
        freed = sums.select(F.col("context").alias("gram"), "documents", F.log(F.col("left_toxic") / F.col("left_ordinary")).alias("ratio"))
        parts.append(level.select("gram", "documents", "ratio"))
        if n == 1:
            base = float(freed.first()["ratio"])
        else:
            parts.append(freed)
        shorter = level.select(F.col("gram").alias("rest"), *[F.col(c).alias(f"low_{c}") for c in CLASSES])
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table.groupBy("gram").agg(F.max("documents").alias("documents"), F.sum("ratio").cast("float").alias("ratio")), base


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chunk = Chunk(batch.column(0).to_pylist())
        keys = hash_spans(chunk.codes, chunk.starts, chunk.ends).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(1), batch.column(2)], ["word", "documents", "ratio"])


def _held(common: DataFrame | None) -> Ratios:
    if common is None:
        return Ratios(np.zeros(0, np.int64), np.zeros(0, np.float32))
    rows = common.select("word", "ratio").toArrow()
    return Ratios(rows.column("word").to_numpy(), rows.column("ratio").to_numpy())


def log_ratios(counts: DataFrame, cfg: ToxicityConfig) -> Ratios:
    """log P(word | toxic) - log P(word | ordinary) of the words to broadcast, by word hash."""
    return _held(ratio_tables(counts, cfg)[0])


def _sums(ratios, with_rest: bool, order: int):
    @F.arrow_udf("struct<total: double, words: bigint, key: binary, rest: array<struct<word: bigint, times: bigint>>>")
    def sums(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            totals, counts, keys, lengths, rest, times = ([np.zeros(0, t)] for t in (float, np.int64, object, np.int64, np.int64, np.int64))
            for texts in chunks(batch):
                s = Symbols(texts, order)
                owner = s.owner[s.seen]
                at, index = s.whole()
                values, open_ = np.zeros(len(at)), []
                for words in s.keys(at):
                    value, held = ratios.value.find(words)
                    values += value
                    open_.append((words, ~held))
                counts.append(s.sizes)
                totals.append(np.bincount(owner, values[index], len(texts)))
                if with_rest:
                    asked, by = (np.concatenate(x) for x in zip(*[(words[index][o[index]], owner[o[index]]) for words, o in open_]))
                    words, number = np.unique(asked, return_inverse=True)
                    pairs, n = np.unique(by * max(1, len(words)) + number, return_counts=True)
                    rest.append(words[pairs % max(1, len(words))])
                    times.append(n)
                    lengths.append(np.bincount(pairs // max(1, len(words)), minlength=len(texts)))
                    keys.append(np.array([blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], object))
                else:
                    lengths.append(np.zeros(len(texts), np.int64))
                    keys.append(np.full(len(texts), None, object))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (rest, times)], ["word", "times"])
            yield pa.StructArray.from_arrays(
                [
                    pa.array(np.concatenate(totals)),
                    pa.array(np.concatenate(counts).astype(np.int64)),
                    pa.array(np.concatenate(keys).tolist(), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), items),
                ],
                ["total", "words", "key", "rest"],
            )

    return sums


def _with_mean(rows: DataFrame, text: Column, ratios, rare: DataFrame | None, base: float, order: int) -> DataFrame:
    """`rows` plus `_mean`, the mean log-ratio of the symbols of `text`, 0 without words.

    N-grams that are not broadcast are joined once per distinct text. None of them is common, so no key of that join is hot;
    copies of one text only meet again where its sum comes back, and Spark splits that side.
    """
    mean = lambda total: total / F.greatest("_s.words", F.lit(1)) + F.when(F.col("_s.words") > 0, base).otherwise(0.0)
    held = rows.withColumn("_s", _sums(ratios, rare is not None, order)(text))
    if rare is None:
        return held.withColumn("_mean", mean(F.col("_s.total"))).drop("_s")
    asked = held.select(F.col("_s.key").alias("_key"), F.explode("_s.rest").alias("_w"))
    asked = asked.groupBy("_key", F.col("_w.word").alias("word")).agg(F.max("_w.times").alias("_times"))
    found = cut(asked.join(rare, "word").groupBy("_key").agg(F.sum(F.col("_times") * F.col("ratio").cast("double")).alias("_rare")))
    total = F.col("_s.total") + F.coalesce("_rare", F.lit(0.0))
    joined = held.withColumn("_key", F.col("_s.key")).join(found, "_key", "left")
    return joined.withColumn("_mean", mean(total)).drop("_s", "_key", "_rare")


def _fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression by Newton steps, with a weak pull to zero."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1.0) if len(y) else 0.05
        return 0.0, float(np.log(rate / (1 - rate)))
    scale = float(np.abs(x).max()) or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w = w + np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (y - p) - 1e-3 * w)
    return max(0.0, float(w[0] / scale)), float(w[1])


def scored(
    docs: DataFrame,
    labels: DataFrame,
    cfg: ToxicityConfig = ToxicityConfig(),
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    held_out: int = 5,
) -> DataFrame:
    """All columns of `docs` plus the struct `toxicity`: `held_out`, `score` from 0 to 1, `predicted` 1 from one half on.

    Labels are learned from documents whose crc32(id) is no multiple of `held_out`; a document with a null id or label is never
    learned from and not held out. Of several labels of an id the greatest counts. A text without words has the score of a
    document whose likelihoods are equal. Without labels of both classes all scores are the share of the one class or, with
    none at all, 5 percent. Repeated rows count each time. A column `toxicity` of `docs` is replaced.
    """
    spark = docs.sparkSession
    crc = id_remainder("id", 1 << 32)
    known = cut(
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .dropna()
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .filter(crc % held_out != 0)
        .withColumn("fits", F.floor(crc / held_out) % cfg.fold_of == 0)
    )
    n = known.count()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = rows.join(counted_hint(known.filter("NOT fits").select("id", "label"), n), "id")
    table, base = gram_ratios(gram_counts(counted, cfg), cfg)
    common = rare = None
    if table is not None:
        common, rare = most_common(cut(table.mapInArrow(_keyed, "word long, documents long, ratio float")), cfg)
    ratios = spark.sparkContext.broadcast(_held(common))

    chosen = known.filter("fits").orderBy(F.xxhash64("id"), "id").limit(cfg.sample).select("id", "label")
    fold = rows.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.max("text").alias("text"))  # a row per id, however often it repeats
    sample = _with_mean(fold, F.col("text"), ratios, rare, base, cfg.order).select(F.col("_mean").alias("x"), "label").toArrow()
    slope, offset = _fit(sample.column("x").to_numpy(), sample.column("label").to_numpy().astype(float))

    score = 1 / (1 + F.exp(-F.least(F.lit(500.0), F.greatest(F.lit(-500.0), F.lit(slope) * F.col("_mean") + F.lit(offset)))))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "toxicity"])
    texts = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    return (
        _with_mean(texts, F.col("_text"), ratios, rare, base, cfg.order)
        .withColumn("score", score)
        .select(
            "row.*",
            F.struct(
                F.coalesce(crc % held_out == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
            ).alias("toxicity"),
        )
    )
