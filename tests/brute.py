"""Slow, obvious versions of the operators, one session at a time in plain Python."""

from __future__ import annotations

WEIGHTS = {"system": 4.0, "fact": 4.0, "user": 1.0, "assistant": 1.0, "tool": 0.25, "thinking": 0.15}


def weight(signal: int) -> float:
    if signal & 9:
        return 4.0
    if signal & 6:
        return 1.0
    if signal & 32:
        return 0.15
    return 0.25 if signal & 16 else 0.6


def tokens(text: str) -> int:
    return len(text.encode()) // 4 + 1


def keep_flags(signals: list[int], half_life: float, threshold: float, stable: int = 0) -> list[bool]:
    n = len(signals)
    return [
        i < stable or bool(s & 9) or weight(s) * 2.0 ** (-(n - 1 - i) / half_life) >= threshold
        for i, s in enumerate(signals)
    ]


def call_units(rows: list[dict]) -> list[list[dict]]:
    units: list[list[dict]] = []
    open_call = False
    for r in rows:
        if r["role"] == "tool" and open_call:
            units[-1].append(r)
            continue
        open_call = r["role"] == "assistant" and r["has_calls"]
        units.append([r])
    return units


def pair_units(rows: list[dict]) -> list[list[dict]]:
    units, i = [], 0
    while i < len(rows):
        opens = rows[i]["role"] == "assistant" and rows[i]["has_use"]
        if opens and i + 1 < len(rows) and rows[i + 1]["has_result"]:
            units.append(rows[i : i + 2])
            i += 2
        else:
            units.append(rows[i : i + 1])
            i += 1
    return units


def repaired(rows: list[dict]) -> list[int]:
    kept: list[dict] = []
    for r in rows:
        if not kept and r["role"] != "user":
            continue
        if r["has_result"]:
            giver = kept[-1] if kept else None
            if giver is None or giver["role"] != "assistant" or not set(r["result_ids"]) <= set(giver["use_ids"]):
                continue
        kept.append(r)
    out = []
    for i, r in enumerate(kept):
        if r["role"] == "assistant" and r["use_ids"]:
            answer = set(kept[i + 1]["result_ids"]) if i + 1 < len(kept) else set()
            if not answer & set(r["use_ids"]):
                continue
        out.append(r["pos"])
    return out


def fifo(facts: list[str], capacity: int) -> list[str]:
    held: list[str] = []
    for f in facts:
        if f not in held:
            held.append(f)
            held = held[-capacity:]
    return held


def repetition(text: str, width: int = 8) -> float:
    words = text.split()
    if len(words) < 2 * width:
        return 0.0
    shingles = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]
    return 1 - len(set(shingles)) / len(shingles)


def leaders(sigs: list[int], threshold: int) -> tuple[list[int], list[int]]:
    """Kept items of both policies; items are list positions."""
    reps: list[int] = []
    newest: dict[int, int] = {}
    for i, s in enumerate(sigs):
        for k, r in enumerate(reps):
            if bin((s ^ sigs[r]) & (2**64 - 1)).count("1") <= threshold:
                newest[k] = i
                break
        else:
            newest[len(reps)] = i
            reps.append(i)
    return reps, sorted(newest.values())
