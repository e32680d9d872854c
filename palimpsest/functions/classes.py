"""Message classes, survival weights and the survival test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest import config as C
from palimpsest.config import PruneConfig
from palimpsest.functions.text import strip

# Marks that pin a framework message.
PIN_MARKS = ["fact", "durable", "pin"]

# Words that mark a lasting rule in a user text (English and Portuguese), and the
# longest text for which they count.
DURABLE_MAX_CHARS = 600
DURABLE_PATTERN = (
    r"(?iuU)(?:\b(?:must|never|always|shall|required|remember|reminder|important)\b"
    r"|\bdon'?t forget\b|\bnote this\b|\b(?:we|as) agreed\b|\bdecision:"
    r"|\b(?:deve[mr]?|nunca|sempre|obrigat[óo]ri[oa]|lembre(?:te)?|anote"
    r"|importante|decidimos|combinamos|ficou definido)\b"
    r"|\bn[ãa]o (?:pode|esque[çc]a)\b)"
)


def class_of_role(role: Column) -> Column:
    """system, user, assistant, tool, fact; anything else, also null, is a user turn."""
    return (
        F.when(role == "system", C.SYSTEM)
        .when(role == "assistant", C.ASSISTANT)
        .when(role == "fact", C.FACT)
        .when(role == "tool", C.TOOL)
        .otherwise(C.USER)
    )


def class_of_marked(role: Column, mark: Column, n_tool_calls: Column, text: Column) -> Column:
    """Framework messages: a pin mark wins, tool plumbing without text counts as tool output."""
    blank = strip(F.coalesce(text, F.lit(""))) == ""
    return (
        F.when(F.lower(mark).isin(PIN_MARKS), C.FACT)
        .when(role == "system", C.SYSTEM)
        .when(role.isin("tool", "function"), C.TOOL)
        .when((role == "assistant") & (F.coalesce(n_tool_calls, F.lit(0)) > 0) & blank, C.TOOL)
        .when(role == "assistant", C.ASSISTANT)
        .otherwise(C.USER)
    )


def looks_durable(text: Column) -> Column:
    trimmed = strip(F.coalesce(text, F.lit("")))
    return F.char_length(trimmed).between(1, DURABLE_MAX_CHARS) & trimmed.rlike(DURABLE_PATTERN)


def is_tagged_fact(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)^\s*FACT:"), F.lit(False))


def class_of_unit(role: Column, pinned: Column, is_tool: Column, durable: Column) -> Column:
    """Class of a purge unit from its first message and its tool flag; the first rule that fits wins."""
    return (
        F.when(F.coalesce(pinned, F.lit(False)), C.FACT)
        .when(role == "system", C.SYSTEM)
        .when(is_tool, C.TOOL)
        .when(role == "assistant", C.ASSISTANT)
        .when(durable, C.FACT)
        .otherwise(C.USER)
    )


def has_flag(signal: Column, flags: int) -> Column:
    return signal.bitwiseAND(F.lit(flags)) != 0


def class_name(signal: Column) -> Column:
    """Label for reports; the highest-priority flag wins."""
    return (
        F.when(has_flag(signal, C.FACT), "fact")
        .when(has_flag(signal, C.SYSTEM), "system")
        .when(has_flag(signal, C.USER), "user")
        .when(has_flag(signal, C.ASSISTANT), "assistant")
        .when(has_flag(signal, C.THINKING), "thinking")
        .when(has_flag(signal, C.TOOL), "tool")
        .otherwise("other")
    )


def weight_of(signal: Column) -> Column:
    return by_weight(signal, lambda weight: F.lit(weight))


def by_weight(signal: Column, value) -> Column:
    """CASE over the weight classes in priority order; `value` maps a weight to a column."""
    return (
        F.when(has_flag(signal, C.PROTECTED), value(C.WEIGHT_PROTECTED))
        .when(has_flag(signal, C.USER | C.ASSISTANT), value(C.WEIGHT_TALK))
        .when(has_flag(signal, C.THINKING), value(C.WEIGHT_THINKING))
        .when(has_flag(signal, C.TOOL), value(C.WEIGHT_TOOL))
        .otherwise(value(C.WEIGHT_OTHER))
    )


def cutoff_of(signal: Column, cfg: PruneConfig) -> Column:
    """Largest age at which the row stays; null for rows that always stay."""

    def cutoff(weight: float) -> Column:
        age = None if weight == C.WEIGHT_PROTECTED else cfg.cutoff_age(weight)
        return F.lit(age).cast("bigint")

    return by_weight(signal, cutoff)


def survives(signal: Column, age: Column, cfg: PruneConfig) -> Column:
    return F.coalesce(age <= cutoff_of(signal, cfg), F.lit(True))
