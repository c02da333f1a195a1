"""Problem 4: splitting oversized items at natural boundaries.

Each position of an item has a boundary strength (blank line, line, sentence,
clause, word, punctuation, none). A sparse table answers the range-maximum
queries over these strengths, ties to the right: the next cut is the strongest
position in the whole permissible window (from ``shortest`` characters, by default
one more than the overlap, to the limit), and the piece after it begins ``overlap``
characters before the cut. Among equally strong cuts the last one is taken, so pieces
are as long as their boundaries allow.

Items never meet: one ``mapInArrow`` without a shuffle. Lines too short to hold
an oversized item are filtered on the JVM's side before any row reaches Python.
The table is built for stretches of ``STRETCH`` positions, so an item of any
length needs a bounded index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .loglines import blocks_of, clean, decode, part_texts, slices

LIMIT, OVERLAP = 4000, 200
STRETCH = 1 << 16
#: Strengths of a cut, strongest first.
BLANK_LINE, LINE, SENTENCE, CLAUSE, WORD, MARK, ANY, NEVER = 7, 6, 5, 4, 3, 2, 1, 0


def _table(chars: str) -> np.ndarray:
    """Membership by code point, up to U+FFFF."""
    out = np.zeros(0x10000, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_SPACE = _table(" \t\n\r\v\f\u0085                 　")
_NEWLINE = _table("\n\u0085  ")
_STOP = _table(".!?…‽")
_WIDE_STOP = _table("。！？．")
_COMMA = _table(",;:")
_WIDE_COMMA = _table("，、；：")
_CLOSING = _table("\"')]}»”’」』）*_`")
_MARKS = _table("-/|)]}>\\,;:.!?=")
#: Characters that a cut may not stand before: combining marks, joiners, selectors.
_BOUND = np.zeros(0x10000, dtype=bool)
for _a, _b in ((0x300, 0x370), (0x483, 0x48A), (0x591, 0x5BE), (0x610, 0x61B), (0x64B, 0x660), (0x93A, 0x93D), (0x93E, 0x950), (0x200B, 0x2010), (0x20D0, 0x20F1), (0x3099, 0x309B), (0xDC00, 0xE000), (0xFE00, 0xFE10), (0xFE20, 0xFE30)):
    _BOUND[_a:_b] = True


def strengths(text: str) -> np.ndarray:
    """Strength of a cut before each position 0..n (uint8); 0 and n are strongest."""
    full = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    c = np.minimum(full, 0xFFFF).astype(np.int64)
    n = len(c)
    s = np.full(n + 1, ANY, dtype=np.uint8)
    if n == 0:
        return s
    space, newline = _SPACE[c], _NEWLINE[c]
    stop = _STOP[c].copy()
    closing = _CLOSING[c]
    for _ in range(2):  # a stop may be followed by closing quotes or brackets
        stop[1:] |= closing[1:] & stop[:-1]
    at = s[1:]  # at[i]: a cut after character i
    at[_MARKS[c]] = MARK
    at[space] = WORD
    at[1:][space[1:] & _COMMA[c[:-1]]] = CLAUSE
    at[_WIDE_COMMA[c]] = CLAUSE
    at[1:][space[1:] & stop[:-1]] = SENTENCE
    at[_WIDE_STOP[c]] = SENTENCE
    at[newline] = LINE
    at[1:][newline[1:] & newline[:-1]] = BLANK_LINE
    cr = c == 13
    at[2:][newline[2:] & cr[1:-1] & newline[:-2]] = BLANK_LINE
    s[1:n][_BOUND[c[1:]]] = NEVER  # before a mark that belongs to the character before
    s[1:n][cr[:-1] & newline[1:]] = NEVER  # inside CR LF
    # emoji modifiers and what follows a joiner
    s[1:n][((full[1:] >= 0x1F3FB) & (full[1:] <= 0x1F3FF)) | (full[:-1] == 0x200D)] = NEVER
    s[0] = s[n] = BLANK_LINE
    return s


class RangeMaximum:
    """Sparse table: the rightmost strongest position of a range, in O(1)."""

    def __init__(self, strength: np.ndarray, widest: int):
        self.strength, self.levels = strength, [np.arange(len(strength), dtype=np.int32)]
        k = 1
        while 2 * k <= min(widest, len(strength)):
            last = self.levels[-1]
            a, b = last[:-k], last[k:]
            m = len(strength) - 2 * k + 1
            a, b = a[:m], b[:m]
            self.levels.append(np.where(strength[b] >= strength[a], b, a))
            k *= 2

    def best(self, lo: int, hi: int) -> int:
        """Of lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        a, b = int(self.levels[k][lo]), int(self.levels[k][hi - (1 << k) + 1])
        return b if self.strength[b] >= self.strength[a] else a


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP, shortest: int | None = None) -> list[tuple[int, int, int]]:
    """(begin, end, strength of the end) of the pieces of a text, in order.

    A text within the limit is one piece. Each next piece begins ``overlap``
    before the end of the one before; none is longer than ``limit`` nor, the last one
    left out, shorter than ``shortest`` (at least overlap + 1, so that each goes on).
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    shortest = max(overlap + 1, shortest or 0)
    if shortest > limit:
        raise ValueError("the shortest piece must be within the limit")
    n = len(text)
    if n <= limit:
        return [(0, n, BLANK_LINE)]
    s = strengths(text)
    out, begin, base, index = [], 0, 0, None
    while n - begin > limit:
        if index is None or begin + limit >= base + len(index.strength):
            base = begin
            index = RangeMaximum(s[base : base + STRETCH + limit + 1], limit)
        cut = index.best(begin + shortest - base, begin + limit - base)
        out.append((begin, cut + base, int(index.strength[cut])))
        begin = cut + base - overlap
    out.append((begin, n, BLANK_LINE))
    return out


def items_of(line: dict) -> Iterator[tuple[int, str, str]]:
    """(place in message.content, kind, text) of the line's text blocks and tool results."""
    for at, b in enumerate(blocks_of(line)):
        if not isinstance(b, dict):
            continue
        if b.get("type") == "text" and isinstance(b.get("text"), str):
            yield at, "text", b["text"]
        elif b.get("type") == "tool_result":
            yield at, "tool_result", "".join(part_texts(b.get("content")))


def split_log_items(lines: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, texts: bool = True, shortest: int | None = None) -> DataFrame:
    """The pieces of every oversized text block and tool result of claude-code lines.

    One row a piece: line_id, block_no, kind, piece_no, begin, end (code points of
    the decoded item), strength of its end, piece_text (null if not ``texts``).
    Invalid, null and empty lines and items within the limit have no rows; repeated
    lines each have theirs; a null line_id stays null; an empty table gives an empty
    one; other columns are not read. Items of any length are split whole; a lone
    surrogate comes out as ``?``.
    """
    import pyarrow as pa

    rows = lines.where((F.col("agent") == "claude-code") & (F.length("raw_line") > limit)).select("line_id", "raw_line")
    kinds = [("line_id", pa.int64()), ("block_no", pa.int64()), ("kind", pa.string()), ("piece_no", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("strength", pa.int32()), ("piece_text", pa.string())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 200):
                out: list[tuple] = []
                for line_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for block_no, kind, text in items_of(decode(raw) or {}):
                        if len(text) > limit:
                            for k, (a, z, strength) in enumerate(split(text, limit, overlap, shortest)):
                                out.append((line_id, block_no, kind, k, a, z, strength, clean(text[a:z]) if texts else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out) if out else [[]] * len(kinds), kinds)], schema=schema)

    return rows.mapInArrow(run, "line_id long, block_no long, kind string, piece_no int, begin long, end long, strength int, piece_text string")


def oversized(lines: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(line_id, block_no) of the items that ``split_log_items`` cuts."""
    return split_log_items(lines, limit, overlap, texts=False).where("piece_no = 0").select("line_id", "block_no")
