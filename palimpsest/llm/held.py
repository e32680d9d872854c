"""One value per Python worker, built from a broadcast and known by its content."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")

_held: dict[str, tuple[str, object]] = {}


def held(kind: str, digest: str, build: Callable[[], T]) -> T:
    """The worker's value of this kind, built anew when the digest of its source is another; the one before is let go first."""
    found = _held.get(kind)
    if found is None or found[0] != digest:
        found = None
        _held.pop(kind, None)
        found = _held[kind] = (digest, build())
    return found[1]
