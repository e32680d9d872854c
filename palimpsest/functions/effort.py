"""Lexical effort of a task text, its tier, and the thinking budget a request should carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import text as T

# Word tables (English and Portuguese). Stems match the start of a word, all others the
# whole word, after characters that are no letters or digits have been taken off both ends.
HARD_STEMS = [
    "design", "architect", "optimi", "refactor", "implement", "analy", "compar",
    "debug", "deriv", "evaluat", "integrat", "migrat", "audit",
    "projet", "arquitet", "otimiz", "refator", "implement", "analis", "planej",
    "avali", "estud", "viabilid", "estrateg", "constru", "desenvolv", "valid",
    "verific", "revis", "integr", "corrij", "corrig", "diagnostic", "investig",
]
HARD_WORDS = [
    "prove", "plan", "why", "how", "erro", "error", "bug", "falha", "broken",
    "gere", "monte", "compare", "depure", "prova",
]
CONSTRAINT_WORDS = [
    "must", "never", "always", "without", "ensure", "require", "requirement",
    "constraint", "invariant", "except",
    "deve", "nunca", "sempre", "sem", "garanta", "requisito", "restrição",
    "restricao", "invariante", "exceto", "obrigatório", "obrigatorio",
]
TRIVIAL_WORDS = [
    "ok", "okay", "yes", "no", "thanks", "continue", "sure", "great", "good",
    "sim", "não", "nao", "obrigado", "obrigada", "continue", "prossiga",
    "segue", "beleza", "certo", "show", "valeu",
]
CODE_WORDS = [
    "fn", "def", "class", "import", "return", "const", "let", "select", "async",
    "struct", "impl", "function", "var", "pub",
]
CODE_CHARS = "{};()=<>`"

# Tiers with their budgets, and the smallest budget a request may carry.
BUDGETS = {"off": 0, "low": 1024, "medium": 4096, "high": 16384}
MIN_BUDGET = 1024
ROOM = 256

_EDGE = r"[^\p{IsAlphabetic}\p{N}\s]*"


def _hits(lowered: Column, words: list[str], stems: list[str] = ()) -> Column:
    """Words of the text that are in the table: one regex pass, no array of words."""
    whole = "|".join(dict.fromkeys(words))
    choices = f"(?:{whole})(?={_EDGE}(?!\\S))"
    if stems:
        choices = f"(?:{'|'.join(dict.fromkeys(stems))}|{choices})"
    return F.regexp_count(lowered, F.lit(rf"(?U)(?<!\S){_EDGE}{choices}")).cast("bigint")


def _single(value: Column | float) -> Column:
    """The score is defined in 32-bit floats; tiers change at exact thresholds."""
    return (value if isinstance(value, Column) else F.lit(value)).cast("float")


def _capped(value: Column) -> Column:
    return F.least(value, _single(1.0))


def _removed(text: Column, characters: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, characters, ""))).cast("bigint")


def effort_signals(text: Column) -> Column:
    """Struct of the raw counts. The text is lowered and split once."""

    def counts(lowered: Column) -> Column:
        code = _hits(lowered, CODE_WORDS) + F.floor(_removed(lowered, CODE_CHARS) / 6).cast("bigint")
        return T.bind(
            T.words(lowered),
            lambda pieces: F.struct(
                F.size(pieces).cast("bigint").alias("words"),
                F.size(F.array_distinct(pieces)).cast("bigint").alias("distinct_words"),
                code.alias("code_hits"),
                _removed(lowered, "0123456789").alias("digits"),
                F.octet_length(lowered).cast("bigint").alias("bytes"),
                _hits(lowered, HARD_WORDS, HARD_STEMS).alias("hard_hits"),
                _hits(lowered, CONSTRAINT_WORDS).alias("constraint_hits"),
                _hits(lowered, TRIVIAL_WORDS).alias("trivial_hits"),
            ),
        )

    return T.bind(F.lower(F.coalesce(text, F.lit(""))), counts)


def effort_of(text: Column) -> Column:
    """Struct of signals, score, tier and budget_tokens.

    The counts are bound, since a plain struct column would be taken apart by the optimizer and every
    use of a count would scan the text again.
    """

    def scored(signals: Column) -> Column:
        return T.bind(
            effort_score(signals),
            lambda score: T.bind(
                effort_tier(score, signals),
                lambda tier: F.struct(
                    signals.alias("signals"),
                    score.alias("score"),
                    tier.alias("tier"),
                    budget_of(tier).alias("budget_tokens"),
                ),
            ),
        )

    return T.bind(effort_signals(text), scored)


def effort_score(signals: Column) -> Column:
    """0 .. 1; very short or purely acknowledging texts stay at 0.05 or less."""
    n = signals["words"]

    def share(count: Column, full: float) -> Column:
        return _capped(_single(count) / _single(full))

    digit_ratio = F.when(
        signals["bytes"] > 0, (_single(signals["digits"]) / _single(signals["bytes"])).cast("float")
    ).otherwise(_single(0.0))
    novelty = F.when(n > 0, (_single(signals["distinct_words"]) / _single(n)).cast("float")).otherwise(_single(0.0))
    raw = (
        _single(0.30) * _single(share(n, 400.0))
        + _single(0.25) * _single(share(signals["hard_hits"], 3.0))
        + _single(0.20) * _single(share(signals["constraint_hits"], 6.0))
        + _single(0.15) * _single(share(signals["code_hits"], 12.0))
        + _single(0.10) * _single(_capped(digit_ratio * _single(8.0)))
    )
    score = F.least(F.greatest(raw * (_single(0.5) + _single(0.5) * novelty), _single(0.0)), _single(1.0))
    trivial = ((n < 8) & (signals["hard_hits"] == 0) & (signals["code_hits"] == 0)) | (
        (n <= 3) & (signals["trivial_hits"] > 0)
    )
    return F.when(trivial, F.least(score, _single(0.05))).otherwise(score)


def effort_tier(score: Column, signals: Column) -> Column:
    """A hard verb in a text of four words or more guarantees the low tier."""
    lifted = (signals["hard_hits"] >= 1) & (signals["words"] >= 4) & (score > _single(0.05))
    return (
        F.when(score < _single(0.15), F.when(lifted, "low").otherwise("off"))
        .when(score < _single(0.40), "low")
        .when(score < _single(0.70), "medium")
        .otherwise("high")
    )


def budget_of(tier: Column) -> Column:
    return (
        F.when(tier == "off", BUDGETS["off"])
        .when(tier == "low", BUDGETS["low"])
        .when(tier == "medium", BUDGETS["medium"])
        .otherwise(BUDGETS["high"])
        .cast("bigint")
    )


def policy_action(surface: Column, tier: Column, has_reasoning: Column, thinking_type: Column, thinking_budget: Column,
                  temperature: Column, max_tokens: Column) -> Column:
    """What happens to the effort fields of a request. Effort is filled in or lowered, never raised."""
    budget = budget_of(tier)
    current = F.coalesce(thinking_budget, F.lit(0)).cast("bigint")
    chat = (
        F.when(F.coalesce(has_reasoning, F.lit(False)), "client_set")
        .when(tier == "off", "disabled")
        .otherwise(F.concat(F.lit("effort="), tier))
    )
    lowered = F.concat(F.lit("downgraded "), current.cast("string"), F.lit(f"->{MIN_BUDGET}"))
    room = F.coalesce(max_tokens > budget + ROOM, F.lit(False)) & F.coalesce(temperature == 1, F.lit(True))
    blocks = (
        F.when(
            F.coalesce(thinking_type == "enabled", F.lit(False)),
            F.when((tier == "off") & (current > MIN_BUDGET), lowered).otherwise("client_set"),
        )
        .when(
            thinking_type.isNull() & tier.isin("medium", "high") & room,
            F.concat(F.lit("added "), budget.cast("string")),
        )
        .otherwise("none")
    )
    return F.when(surface == "chat", chat).otherwise(blocks)
