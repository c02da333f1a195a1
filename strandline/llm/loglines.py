"""Decoding agents' log lines in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def decode(raw: str | None) -> dict | None:
    """The line's JSON object, or None if it is none."""
    if not raw:
        return None
    try:
        o = json.loads(raw)
    except (ValueError, RecursionError):
        return None
    return o if isinstance(o, dict) else None


def blocks_of(line: dict) -> list:
    """The blocks of ``message.content`` where it is an array."""
    m = line.get("message")
    c = m.get("content") if isinstance(m, dict) else None
    return c if isinstance(c, list) else []


def part_texts(content: object) -> Iterator[str]:
    """The texts of a tool result: a string, or the texts of an array's parts."""
    if isinstance(content, str):
        yield content
    elif isinstance(content, list):
        for p in content:
            if isinstance(p, str):
                yield p
            elif isinstance(p, dict) and isinstance(p.get("text"), str):
                yield p["text"]


def instant(stamp: object) -> int | None:
    """Microseconds since 1970 of an ISO timestamp in any zone; None if it is no time.
    A timestamp without a zone counts as UTC."""
    if not isinstance(stamp, str) or len(stamp) < 10:
        return None
    try:
        t = datetime.fromisoformat(stamp.strip())
    except ValueError:
        return None
    if t.tzinfo is None:
        t = t.replace(tzinfo=timezone.utc)
    d = t - _EPOCH
    return (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds


def clean(text: str) -> str:
    """``text`` without lone surrogates, which no column can hold."""
    return text.encode("utf-8", "replace").decode("utf-8") if any("\ud800" <= c <= "\udfff" for c in text) else text


def slices(batch, rows: int) -> Iterable:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
