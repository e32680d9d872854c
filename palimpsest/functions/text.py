"""Text measures: token sizes, words, shingles, one-line digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, so that the no-break space also separates words.
SPACES = r"(?U)\s+"
NOT_BLANK = r"(?U)\S"


def token_size(text: Column) -> Column:
    """UTF-8 bytes div 4, plus one."""
    return token_size_of_bytes(F.octet_length(F.coalesce(text, F.lit(""))))


def token_size_of_bytes(n_bytes: Column) -> Column:
    return F.floor(n_bytes.cast("bigint") / 4).cast("bigint") + F.lit(1).cast("bigint")


def char_quarter(text: Column) -> Column:
    """Characters div 4: the size used for units outside the purge zone."""
    return F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4).cast("bigint")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """Words between runs of white space; an empty array for blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def first_words(text: Column, n: int) -> Column:
    """The first `n` words, without splitting the rest of the text."""
    # A leading space gives an empty piece; the last piece of a limited split is all the rest.
    pieces = F.slice(F.split(text, SPACES, n + 2), 1, n + 1)
    return F.slice(F.filter(pieces, lambda w: w != ""), 1, n)


def bind(value: Column, use) -> Column:
    """`use(value)` with the value computed once per row, also where `use` reads it inside a lambda.

    A plain column expression inside a higher-order function is evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(tokens: Column, width: int) -> Column:
    """One 64-bit hash per run of `width` tokens; empty when there are fewer tokens."""

    def hashes(words_: Column) -> Column:
        return F.when(
            F.size(words_) >= width,
            F.transform(
                F.sequence(F.lit(1), F.size(words_) - (width - 1)),
                lambda i: F.xxhash64(F.slice(words_, i, F.lit(width))),
            ),
        ).otherwise(F.array().cast("array<bigint>"))

    return bind(tokens, hashes)


def repetition_score(text: Column, width: int = 8) -> Column:
    """Share of repeated shingles, 0 for texts shorter than two windows. No shuffle: one row at a time."""
    width = max(int(width), 1)

    def score(words_: Column) -> Column:
        repeated = bind(shingle_hashes(words_, width), lambda h: 1.0 - F.size(F.array_distinct(h)) / F.size(h))
        return F.when(F.size(words_) < 2 * width, F.lit(0.0)).otherwise(repeated)

    return bind(words(text), score)


def one_line_digest(text: Column, limit: int = 120) -> Column:
    """White space collapsed, cut at `limit` bytes; the character on the cut stays whole."""
    flat = F.array_join(words(text), " ")
    raw = F.encode(flat, "UTF-8")
    n_bytes = F.octet_length(flat)
    # A character that spans the cut adds at most three continuation bytes (10xxxxxx).
    head = F.substring(raw, 1, limit + 3)
    extra = F.lit(0)
    for step in (3, 2, 1):
        following = F.hex(F.substring(raw, limit + 1, step))
        extra = F.when(
            (extra == 0) & following.rlike("^([89AB][0-9A-F]){%d}$" % step), F.lit(step)
        ).otherwise(extra)
    cut = F.lit(limit) + extra
    return F.when(n_bytes <= cut, flat).otherwise(
        F.concat(F.decode(head.substr(F.lit(1), cut), "UTF-8"), F.lit("…"))
    )
