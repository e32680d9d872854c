"""Tuning parameters of the session jobs. Wrong values raise on the driver, before any job starts."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

# Class flags of a message. Flags may be combined in one integer.
SYSTEM = 1
USER = 2
ASSISTANT = 4
FACT = 8
TOOL = 16
THINKING = 32
PROTECTED = SYSTEM | FACT

# Survival weights.
WEIGHT_PROTECTED = 4.0
WEIGHT_TALK = 1.0
WEIGHT_THINKING = 0.15
WEIGHT_TOOL = 0.25
WEIGHT_OTHER = 0.6

# Fixed value: tokens counted for a content part that is not text.
NON_TEXT_PART_TOKENS = 1600

# Rows of one session handled together by one task; longer sessions are cut into blocks of this many
# positions and stitched by carried values (operators/sequence.py).
BLOCK_ROWS = 65536


@dataclass(frozen=True)
class PruneConfig:
    """Half-life, threshold and zone settings of a pruning job.

    stable_prefix: leading units that always stay; -1 means "up to the first cache marker".
    quantum: the purge boundary only advances every `quantum` units; 0 turns it off.
    hysteresis: purges that save less than this fraction are held back; 0 turns it off.
    auto_fact: short user texts that state a lasting rule count as facts.
    anchor_first: the first unit always stays (surfaces that must open with the user's first turn).
    block_rows: positions of a session that one task handles; 0 when every session is known to fit
    (see operators.sequence.fitting_block_rows).
    """

    half_life: float = 6.0
    threshold: float = 0.35
    stable_prefix: int = 0
    quantum: int = 0
    hysteresis: float = 0.0
    auto_fact: bool = False
    anchor_first: bool = False
    block_rows: int = BLOCK_ROWS

    def __post_init__(self) -> None:
        if not np.isfinite(self.half_life) or not np.isfinite(self.threshold):
            raise ValueError("half_life and threshold must be finite")
        if self.stable_prefix < -1:
            raise ValueError("stable_prefix must be -1 (auto) or a count")
        if self.quantum < 0 or self.hysteresis < 0:
            raise ValueError("quantum and hysteresis must not be negative")
        if self.block_rows < 0:
            raise ValueError("block_rows must not be negative")

    def with_(self, **changes) -> "PruneConfig":
        return replace(self, **changes)

    @property
    def effective_half_life(self) -> float:
        return max(float(self.half_life), 0.1)

    def cutoff_age(self, weight: float) -> int | None:
        """Largest age at which a row of this weight stays, -1 for none, None for every age.

        Survival is monotone in age, so the decay test becomes one integer comparison. The bound is
        searched in 32-bit floats, the precision in which the rule is defined.
        """
        if self.threshold <= 0:
            return None
        one = np.float32
        half_life, threshold = one(self.effective_half_life), one(self.threshold)

        def alive(age: int) -> bool:
            return bool(one(weight) * one(2.0) ** (-one(age) / half_life) >= threshold)

        if not alive(0):
            return -1
        low, high = 0, 1
        while alive(high):
            low, high = high, high * 2
            if high > 2**40:
                return None
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if alive(middle) else (low, middle)
        return low


# Default threshold for tool-calling agents: the newest tool result stays.
AGENT_CONFIG = PruneConfig(threshold=0.2)
