"""Statistics of whole texts, computed for many documents at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from palimpsest.llm.textarrays import U64, Chunk, hash_spans, mix, spaces, table_of

#: Symbol characters and the length of a repeated run of words.
SYMBOLS = "#*$%&|<>"
RUN = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Model features and how the quality may depend on them: -1 never rises, +1 never falls, 0 free.
FEATURES = {
    "log_words": 0,
    "mean_word_chars": 0,
    "symbols_per_word": -1,
    "duplicate_line_share": -1,
    "repeated_word_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "other_share": 0,
    "exclamations_per_word": -1,
    "bars_per_word": -1,
    "distinct_word_share": 0,
    "words_per_line": 0,
}

LOWER, UPPER, DIGIT, LETTER = 1, 2, 3, 4


@lru_cache
def kinds() -> np.ndarray:
    """Kind of every code point: lower or upper case, digit, other letter; 0 for the rest."""
    table = np.zeros(0x110000, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            table[code] = LOWER if c.islower() else UPPER if c.isupper() else LETTER
        elif c.isdigit():
            table[code] = DIGIT
    return table


@lru_cache
def _symbols() -> np.ndarray:
    return table_of(SYMBOLS)


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each owner."""
    with np.errstate(over="ignore"):
        _, first = np.unique(mix(keys ^ mix(owner.astype(U64))), return_index=True)
    return np.bincount(owner[first], minlength=n)


def repeated_words(hashes: np.ndarray, bounds: np.ndarray, owner: np.ndarray, run: int = RUN) -> np.ndarray:
    """Words of each text that lie in a run of `run` words which the text has twice or more; the first counts as well."""
    n = len(bounds) - 1
    windows = len(hashes) - run + 1
    if windows <= 0:
        return np.zeros(n, np.int64)
    with np.errstate(over="ignore"):
        keys = np.zeros(windows, U64)
        for k in range(run):
            keys = keys * U64(0x9FB21C651E98DF25) + hashes[k : k + windows]
        keys = mix(keys ^ mix(owner[:windows].astype(U64)))
    inside = owner[:windows] == owner[run - 1 :]
    at = np.flatnonzero(inside)
    _, back, times = np.unique(keys[at], return_inverse=True, return_counts=True)
    twice = at[times[back] > 1]
    cover = np.zeros(len(hashes) + 1, np.int64)
    cover[twice] += 1
    cover[twice + run] -= 1
    return np.bincount(owner[np.cumsum(cover)[:-1] > 0], minlength=n)


def statistics(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (texts x COUNTS, integers) and features (texts x FEATURES) of whole texts; all zero for an empty one."""
    chunk = Chunk(texts)
    codes, n = chunk.codes, chunk.n
    word = ~spaces()[codes]
    starts, ends = chunk.spans(word)
    owner = chunk.text_of(starts)
    hashes = hash_spans(codes, starts, ends)
    n_words = np.bincount(owner, minlength=n)
    bounds = np.concatenate([[0], np.cumsum(n_words)])
    word_chars = chunk.count(word)
    symbols = chunk.count(_symbols()[codes])

    breaks = np.flatnonzero(codes == 10)
    line_starts, line_ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(codes)]])
    filled = np.concatenate([[0], np.cumsum(word)])
    full = filled[line_ends] > filled[line_starts]
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_owner = chunk.text_of(line_starts)
    lines = np.bincount(line_owner, minlength=n)
    duplicate = lines - _distinct(hash_spans(codes, line_starts, line_ends), line_owner, n)
    repeated = repeated_words(hashes, bounds, owner)

    kind = kinds()[codes]
    lower, upper, digit = (chunk.count(kind == k) for k in (LOWER, UPPER, DIGIT))
    letters = lower + upper + chunk.count(kind == LETTER)
    words, chars = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    features = np.column_stack(
        [
            np.log1p(n_words),
            word_chars / words,
            symbols / words,
            duplicate / np.maximum(lines, 1),
            repeated / words,
            upper / np.maximum(letters, 1),
            digit / chars,
            (word_chars - letters - digit) / chars,
            chunk.count(codes == ord("!")) / words,
            chunk.count(codes == ord("|")) / words,
            _distinct(hashes, owner, n) / words,
            n_words / np.maximum(lines, 1),
        ]
    )
    return np.column_stack([n_words, word_chars, symbols, duplicate, repeated]).astype(np.int64), features
