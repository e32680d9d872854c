"""Live sessions that forget: blocks expire by decay cycles, and purged turns leave a line of state.

A block's last cycle follows from its level when it comes in, so nothing is decayed from cycle to cycle. Levels, lifetimes, sizes
and the lines that purged turns leave are columns of the stream; the stateful step only files each block under the cycle in which
it expires. A cycle takes the blocks filed under its number and touches no other. The keyed state is one value, read and written
once for a session's rows of a micro-batch: six counters, the bounded list of lines, and the blocks that will expire. Texts of
blocks that never expire are kept in a map with an entry per micro-batch, if contexts are wanted, and read when a cycle asks for them.

The batch form (operators/decay.py) gives the same rows from windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle, TimerValues

from palimpsest import config as C
from palimpsest.functions import text as T
from palimpsest.functions.classes import has_flag
from palimpsest.operators.decay import CYCLE_HALF_LIFE, CYCLE_THRESHOLD, STATE_CAPACITY, initial_level, lifetime, render_state
from palimpsest.streaming.sinks import use_rocks_state

INPUT_COLUMNS = ["session_id", "seq", "kind", "content", "signal", "oxygen"]

_CYCLES = (
    "session_id {key}, cycle BIGINT, purged BIGINT, active_blocks BIGINT, active_tokens BIGINT, "
    "inserted_tokens BIGINT, reclaimed_tokens BIGINT, state ARRAY<STRING>, purpose STRING, body STRING"
)
_COUNTERS = "purpose string, cycle bigint, blocks bigint, tokens bigint, inserted bigint, reclaimed bigint"
_BLOCKS = "lines array<string>, at array<bigint>, seqs array<bigint>, sizes array<bigint>, left_lines array<string>, contents array<string>"


#: A block that will expire: place, size, the line it leaves (None: no line), text (None without contexts).
Block = tuple[int, int, str | None, str | None]


class ExpiryWheel(StatefulProcessor):
    """One row per cycle of a session."""

    def __init__(self, capacity: int, with_context: bool, idle_ms: int | None) -> None:
        self.capacity, self.with_context, self.idle_ms = max(capacity, 1), with_context, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        keep = {} if self.idle_ms is None else {"ttlDurationMs": self.idle_ms}
        self.session = handle.getValueState("session", f"{_COUNTERS}, {_BLOCKS}", **keep)
        self.texts = handle.getMapState("texts", "first bigint", "seqs array<bigint>, contents array<string>", **keep)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        # rows of one session in one micro-batch, which the source's batch limit bounds
        frames = list(rows)
        batch = frames[0] if len(frames) == 1 else pd.concat(frames)
        if not batch["seq"].is_monotonic_increasing:
            batch = batch.sort_values("seq", kind="stable")
        kinds = batch["kind"].tolist()
        purpose, cycle, blocks, tokens, inserted, reclaimed, *lists = self.session.get() or (None, 0, 0, 0, 0, 0, *[()] * 6)
        held = dict.fromkeys(lists[0])
        wheel: dict[int, list[Block]] = {}
        for at, *block in zip(*lists[1:]):
            wheel.setdefault(at, []).append(tuple(block))
        live: dict[int, str] = {}
        lasting: dict[int, str] = {}  # texts of this batch that never expire
        if self.with_context and "cycle" in kinds:
            for _, (seqs, contents) in self.texts.iterator():
                live.update(zip(seqs, contents))
            live.update((seq, content) for due in wheel.values() for seq, _, _, content in due)
        out = []
        for seq, kind, content, size, life, line in zip(batch["seq"].tolist(), kinds, *[batch[c].tolist() for c in ("content", "size", "life", "line")]):
            if kind == "insert":
                blocks, tokens, inserted = blocks + 1, tokens + int(size), inserted + int(size)
                kept = content if self.with_context else None
                if not pd.isna(life):
                    wheel.setdefault(cycle + int(life), []).append((seq, int(size), None if pd.isna(line) else line, kept))
                elif self.with_context:
                    lasting[seq] = kept
                if self.with_context:
                    live[seq] = kept
            elif kind == "purpose":
                purpose = None if pd.isna(content) else content
            elif kind == "note":
                self._hold(held, content)
            else:
                cycle += 1
                due = wheel.pop(cycle, [])
                for gone, size, left, _ in due:
                    blocks, tokens, reclaimed = blocks - 1, tokens - size, reclaimed + size
                    if left is not None:
                        self._hold(held, left)
                    live.pop(gone, None)
                body = "\n".join(live[s] for s in sorted(live)) if self.with_context else None
                out.append((key[0], cycle, len(due), blocks, tokens, inserted, reclaimed, list(held), purpose, body))
        if lasting:
            self.texts.updateValue((min(lasting),), (list(lasting), list(lasting.values())))
        filed = [(at, *block) for at, due in wheel.items() for block in due]
        columns = [list(c) for c in zip(*filed)] if filed else [[] for _ in range(5)]
        self.session.update((purpose, cycle, blocks, tokens, inserted, reclaimed, list(held), *columns))
        if out:
            yield pd.DataFrame(out, columns=["session_id", "cycle", "purged", "active_blocks", "active_tokens", "inserted_tokens", "reclaimed_tokens", "state", "purpose", "body"])

    def _hold(self, held: dict[str, None], line: str) -> None:
        """A line not held yet goes to the end; the oldest leaves a full list."""
        held.setdefault(line)
        if len(held) > self.capacity:
            del held[next(iter(held))]

    def close(self) -> None:
        pass


def prune_live_sessions(
    stream: DataFrame,
    *,
    half_life: float = CYCLE_HALF_LIFE,
    threshold: float = CYCLE_THRESHOLD,
    capacity: int = STATE_CAPACITY,
    absorb: bool = True,
    with_context: bool = True,
    idle_ms: int | None = None,
) -> DataFrame:
    """Stream of session events (INPUT_COLUMNS; kind insert, cycle, note or purpose) to one row per cycle.

    Rows of a session count in the order of `seq` inside a micro-batch and in the order of batches. `context` is purpose, state and
    live texts, null without `with_context`. `idle_ms` drops the state of sessions that have been quiet for that long. Protected
    blocks never expire: their texts stay in the state as long as the session.
    """
    use_rocks_state(stream.sparkSession)
    talk = has_flag(F.col("signal"), C.USER | C.ASSISTANT) & F.lit(absorb)
    text = F.coalesce("content", F.lit(""))
    insert = F.col("kind") == "insert"
    prepared = stream.select(*INPUT_COLUMNS).select(
        "session_id",
        "seq",
        "kind",
        F.when(insert, text).otherwise(F.col("content")).alias("content"),
        T.token_size(text).cast("bigint").alias("size"),
        lifetime(initial_level(F.col("signal"), F.col("oxygen")), F.col("signal"), half_life, threshold).alias("life"),
        F.when(talk, T.one_line_digest(text)).alias("line"),
    )
    processor = ExpiryWheel(capacity, with_context, idle_ms)
    key = stream.schema["session_id"].dataType.simpleString()
    mode = "None" if idle_ms is None else "ProcessingTime"
    cycles = prepared.groupBy("session_id").transformWithStateInPandas(processor, _CYCLES.format(key=key), "Append", mode)
    head = F.when(F.col("purpose").isNotNull(), F.concat("purpose", F.lit("\n"))).otherwise(F.lit(""))
    return cycles.withColumn("context", F.concat(head, render_state(None, F.col("state"), F.col("body")))).withColumn(
        "context", F.when(F.lit(with_context), F.col("context"))
    ).drop("purpose", "body")
