"""SQL fragments of the oracle statements: plain definitions, written for clarity and not for speed."""

from __future__ import annotations

TOKENS = "(strlen(text) // 4 + 1)"

# Conversations chained into ten long sessions.
LONG = """
long AS (
  SELECT conv_id % 10 AS session_id,
         row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn) - 1 AS pos,
         count(*) OVER (PARTITION BY conv_id % 10) AS n, conv_id, turn, role, text
  FROM conversations)"""

# Events of a user as an agent session.
EVENTS = """
ev AS (
  SELECT user_id AS session_id,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         count(*) OVER (PARTITION BY user_id) AS n, ts, event_id, event_type, value,
         CASE event_type WHEN 'error' THEN 'tool' WHEN 'click' THEN 'assistant' WHEN 'view' THEN 'assistant'
              WHEN 'signup' THEN 'system' ELSE 'user' END AS role,
         event_type = 'click' AS has_calls,
         CASE event_type WHEN 'error' THEN 16 WHEN 'view' THEN 32 WHEN 'click' THEN 4 WHEN 'signup' THEN 8
              ELSE 2 END AS signal,
         props AS text
  FROM events)"""


def weight(signal: str) -> str:
    return (
        f"(CASE WHEN ({signal}) & 9 <> 0 THEN 4.0 WHEN ({signal}) & 6 <> 0 THEN 1.0 "
        f"WHEN ({signal}) & 32 <> 0 THEN 0.15 WHEN ({signal}) & 16 <> 0 THEN 0.25 ELSE 0.6 END)::DOUBLE"
    )


ROLE_SIGNAL = (
    "(CASE role WHEN 'system' THEN 1 WHEN 'assistant' THEN 4 WHEN 'fact' THEN 8 WHEN 'tool' THEN 16 ELSE 2 END)"
)


def alive(signal: str, age: str, half_life: float = 6.0, threshold: float = 0.35) -> str:
    return f"(({signal}) & 9 <> 0 OR {weight(signal)} * pow(2.0, -({age}) / {half_life}) >= {threshold})"
