"""Whole texts of an Arrow batch as flat numpy arrays.

Texts are joined with a line feed between them and looked at as one array of code points, so that the work per
document is a few array operations. A chunk holds at most `CHUNK_CHARS` code points, or a single longer text; no
text is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK_CHARS = 1 << 18

#: The white space of `[\x20\x09-\x0D]`.
ASCII_SPACE = " \t\n\x0b\x0c\r"

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C55
BASE = U64(_BASE)


@lru_cache
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, U64), np.full(n - 1, _BASE, U64)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def table_of(chars: str) -> np.ndarray:
    """Truth by code point: the given characters."""
    found = np.zeros(0x110000, bool)
    found[[ord(c) for c in chars]] = True
    return found


@lru_cache
def spaces() -> np.ndarray:
    return table_of(ASCII_SPACE)


class Chunk:
    """Some texts as one array: text i is codes[starts[i]:ends[i]]."""

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, self.n)
        self.codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if self.n else np.zeros(0, np.int64)
        self.ends = self.starts + lengths

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the longest runs where `inside` holds. A run never crosses texts if line feeds are outside."""
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        return edge[0::2], edge[1::2]

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        """Index of the text that holds each position."""
        return np.searchsorted(self.starts, positions, "right") - 1

    def count(self, mask: np.ndarray) -> np.ndarray:
        """Positions of each text where `mask` holds."""
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[self.ends] - sums[self.starts]


def span_hash(sums: np.ndarray, lengths) -> np.ndarray:
    """Hashes of spans from their sums of (code point + 1) times powers of `BASE`, the first point's power being 0."""
    with np.errstate(over="ignore"):
        return mix(sums + np.asarray(lengths).astype(U64) * U64(0xD6E8FEB86659FD93))


def hash_spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of code points; equal spans get equal hashes in every task."""
    out = np.zeros(len(starts), U64)
    lengths = ends - starts
    full = lengths > 0
    if not full.any():
        return out
    starts, lengths = starts[full], lengths[full]
    offsets = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    within = np.arange(lengths.sum()) - np.repeat(offsets, lengths)
    taken = codes[within + np.repeat(starts, lengths)].astype(U64) + U64(1)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(taken * _powers(1 << max(10, int(lengths.max()).bit_length()))[within], offsets)
        out[full] = span_hash(sums, lengths)
    return out


def chunks(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch in order, null as empty, in lists that make chunks."""
    held: list[str] = []
    size = 0
    for value in texts:
        text = value.as_py() or ""
        if held and size + len(text) > CHUNK_CHARS:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield held
