"""Secrets in text: a declared vault, and patterns of common credential shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Credential shapes, tried in this order.
SECRET_PATTERNS = [
    ("aws_access_key", r"AKIA[0-9A-Z]{16}"),
    ("aws_secret", r"(?i)aws_secret[^A-Za-z0-9]{0,3}[A-Za-z0-9/+=]{30,}"),
    ("openai_key", r"sk-[A-Za-z0-9_-]{20,}"),
    ("github_token", r"gh[pousr]_[A-Za-z0-9]{20,}"),
    ("slack_token", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    ("google_api", r"AIza[0-9A-Za-z_-]{30,}"),
    ("bearer", r"(?i)bearer\s+[A-Za-z0-9._-]{16,}"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
MASK = "[REDACTED]"


def _usable(vault: Sequence[str]) -> list[str]:
    return [str(s) for s in vault if s]


def _literals(vault: Sequence[str]) -> Column:
    return F.array(*[F.lit(s) for s in vault])


def redact(text: Column, vault: Sequence[str]) -> Column:
    """Struct (text, hits): every vault value masked, in vault order, on the text as masked so far.

    The vault is a parameter of the job, not a table: it is small and must not be written anywhere.
    """
    secrets = _usable(vault)
    whole = F.coalesce(text, F.lit(""))
    start = F.struct(whole.alias("text"), F.lit(0).cast("bigint").alias("hits"))
    if not secrets:
        return start

    def step(state: Column, secret: Column) -> Column:
        before = state["text"]
        removed = F.char_length(before) - F.char_length(F.replace(before, secret, F.lit("")))
        found = F.floor(removed / F.char_length(secret)).cast("bigint")
        return F.struct(
            F.replace(before, secret, F.lit(MASK)).alias("text"), (state["hits"] + found).alias("hits")
        )

    return F.aggregate(_literals(secrets), start, step)


def leaks(text: Column, vault: Sequence[str]) -> Column:
    secrets = _usable(vault)
    if not secrets:
        return F.lit(False)
    whole = F.coalesce(text, F.lit(""))
    return F.exists(_literals(secrets), lambda s: F.contains(whole, s))


def contained(text: Column, vault: Sequence[str]) -> Column:
    """1-based vault positions of all values the text contains; the values themselves stay hidden."""
    whole = F.coalesce(text, F.lit(""))
    secrets = _usable(vault)
    if not secrets:
        return F.array().cast("array<bigint>")
    entries = F.array(
        *[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(s).alias("s")) for i, s in enumerate(secrets, 1)]
    )
    return F.transform(F.filter(entries, lambda e: F.contains(whole, e["s"])), lambda e: e["i"])


def secret_kind(text: Column, vault: Sequence[str] = (), patterns: Sequence[tuple[str, str]] = SECRET_PATTERNS) -> Column:
    """"vault", or the name of the first pattern that matches; null when there is none."""
    kind = F.when(leaks(text, vault), F.lit("vault"))
    for name, pattern in patterns:
        kind = kind.when(text.rlike(pattern), F.lit(name))
    return kind


def mask_patterns(text: Column, patterns: Sequence[tuple[str, str]] = SECRET_PATTERNS) -> Column:
    for _, pattern in patterns:
        text = F.regexp_replace(text, pattern, MASK)
    return text
