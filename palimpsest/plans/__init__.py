"""Named queries over the given tables, each with the SQL that must give the same rows."""

from palimpsest.plans import registry


def load() -> None:
    """Import every plan module; each registers its queries."""
    from palimpsest.plans import audits, experiments, pruning, scans, signals, streams  # noqa: F401


__all__ = ["load", "registry"]
