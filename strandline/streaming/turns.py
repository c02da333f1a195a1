"""Chunks of settled turns from a stream of messages, one open turn of state a session."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session_id string, first_seq long, last_seq long, chunk_text string"


def _chunk(session: str, rows: list) -> list:
    said = [("User: " if r[1] == "user" else "Assistant: ") + (r[3] or "") for r in rows if r[2] == "text" and r[1] in ("user", "assistant")]
    return [(session, rows[0][0], rows[-1][0], "\n\n".join(said))] if said else []


def _settled(rows: list) -> bool:
    tail = [r for r in rows if r[1] != "system"]
    return bool(tail) and tail[-1][1:3] == ["assistant", "text"]


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, quiet_ms: int | None) -> Iterator[pd.DataFrame]:
    """Rows come in the order of seq within a batch; a turn is closed by the next user text,
    or, when the session has been quiet for the timeout, by a settled tail."""
    session, out = key[0], []
    rows = json.loads(state.get[0]) if state.exists else []
    if state.hasTimedOut:
        if _settled(rows):
            out += _chunk(session, rows)
            rows = []
            state.remove()
        yield pd.DataFrame(out, columns=["session_id", "first_seq", "last_seq", "chunk_text"])
        return
    new = sorted((int(r.seq), r.role, r.kind, r.content) for f in frames for r in f.itertuples())
    for r in map(list, new):
        if rows and r[0] <= rows[-1][0]:
            continue  # it came before
        if r[1:3] == ["user", "text"] and rows:
            out += _chunk(session, rows)
            rows = []
        rows.append(r)
    state.update((json.dumps(rows),))
    if quiet_ms is not None:
        state.setTimeoutDuration(quiet_ms)
    yield pd.DataFrame(out, columns=["session_id", "first_seq", "last_seq", "chunk_text"])


def settled_turns(messages: DataFrame, quiet_ms: int | None = None) -> DataFrame:
    """Chunks of a stream (session_id, seq, role, kind, content).

    With ``quiet_ms`` a session's settled tail is also closed when it has been quiet for so
    long; such a stream runs batches without data for ever, so it never drains.
    """

    def step(key, frames, state):
        return _step(key, frames, state, quiet_ms)

    timeout = GroupStateTimeout.NoTimeout if quiet_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return messages.select("session_id", "seq", "role", "kind", "content").groupBy("session_id").applyInPandasWithState(step, OUT, "open string", "append", timeout)
