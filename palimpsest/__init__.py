"""palimpsest: pruning, auditing and experiment analytics for tables of chat sessions, on Spark."""

from palimpsest.config import PruneConfig

__all__ = ["PruneConfig"]
