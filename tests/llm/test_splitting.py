"""Cuts against brute force; items of log lines."""

import json
import random

import pytest

from strandline.llm import splitting as S
from strandline.sources.tables import table

SCHEMA = "line_id long, agent string, raw_line string, kind string, piece_text int"


def brute(text, limit, overlap, shortest):
    s, out, begin = S.strengths(text), [], 0
    while len(text) - begin > limit:
        window = range(begin + max(shortest, overlap + 1), begin + limit + 1)
        best = max(window, key=lambda p: (s[p], p))
        out.append((begin, best, int(s[best])))
        begin = best - overlap
    return [*out, (begin, len(text), S.BLANK_LINE)]


@pytest.mark.parametrize("shortest", [0, 40])
def test_strongest_cut_of_the_whole_window(shortest):
    rnd = random.Random(7)
    for n in (101, 150, 999, 3000):
        for alphabet in ("ab .", "a\n", "abcdefgh, ;.\n", "a", "x́ é", "文字。，"):
            text = "".join(rnd.choice(alphabet) for _ in range(n))
            got = S.split(text, 100, 20, shortest)
            assert got == brute(text, 100, 20, shortest)
            assert got[0][0] == 0 and got[-1][1] == n and all(z - a <= 100 for a, z, _ in got)
            assert all(b[0] == a[1] - 20 for a, b in zip(got, got[1:]))


def test_a_blank_line_beats_a_later_word():
    text = "a" * 300 + "\n\n" + "word " * 800
    assert S.split(text, 1000, 100)[0] == (0, 302, S.BLANK_LINE)
    assert S.split(text, 1000, 100, 500)[0][2] == S.WORD


def test_long_item_needs_many_stretches():
    text = "Some words stand here. " * 20_000
    got = S.split(text)
    assert "".join(text[a + (200 if a else 0) : z] for a, z, _ in got) == text
    assert all(s == S.SENTENCE for _, _, s in got[:-1]) and all(z - a > 3900 for a, z, _ in got[:-1])


def test_bad_parameters():
    for bad in ((100, 50, 0), (100, -1, 0), (100, 10, 101)):
        with pytest.raises(ValueError):
            S.split("a" * 200, *bad)


def test_whole_table(spark):
    lines = table(spark, "/root/testdata/sf0.01", "log_lines")
    want = {}
    for r in lines.where("agent = 'claude-code'").collect():
        try:
            o = json.loads(r.raw_line or "")
        except ValueError:
            continue
        content = o.get("message", {}).get("content") if isinstance(o, dict) and isinstance(o.get("message"), dict) else None
        for at, b in enumerate(content if isinstance(content, list) else []):
            if isinstance(b, dict) and b.get("type") == "text":
                text = b.get("text")
            elif isinstance(b, dict) and b.get("type") == "tool_result":
                c = b.get("content")
                text = c if isinstance(c, str) else "".join(p if isinstance(p, str) else p.get("text") or "" for p in c or [])
            else:
                continue
            if isinstance(text, str) and len(text) > 4000:
                want[r.line_id, at] = text
    assert {tuple(r) for r in S.oversized(lines).collect()} == set(want)
    pieces = {}
    for r in S.split_log_items(lines).collect():
        pieces.setdefault((r.line_id, r.block_no), []).append(r)
    assert set(pieces) == set(want)
    for key, rows in pieces.items():
        rows.sort(key=lambda r: r.piece_no)
        assert [r.piece_no for r in rows] == list(range(len(rows)))
        assert all(r.piece_text == want[key][r.begin : r.end] and r.end - r.begin <= 4000 for r in rows)
        assert "".join(r.piece_text[200 if r.piece_no else 0 :] for r in rows) == want[key]


def test_cases(spark):
    text = "é" * 4001
    line = lambda *blocks: json.dumps({"message": {"role": "user", "content": list(blocks)}})
    rows = [None, "", "{", "[]", json.dumps({"message": {"content": text}}), line({"type": "text", "text": text[1:]}), line({"type": "text", "text": text}, None, {"type": "tool_result", "content": [{"type": "text", "text": text[:2000]}, text[:2001], None, {"text": None}]}), line({"type": "tool_result", "content": text + "\ud800"}), line({"type": "thinking", "thinking": text})]
    df = spark.createDataFrame([(i if i != 7 else None, "claude-code", r, "clash", 1) for i, r in enumerate([*rows, rows[6]])] + [(50, "codex", rows[6], "", 1), (51, None, rows[6], "", 1)], SCHEMA)
    got = sorted((tuple(r) for r in S.oversized(df).collect()), key=str)
    assert got == sorted([(6, 0), (6, 2), (None, 0), (9, 0), (9, 2)], key=str)
    assert S.split_log_items(df.limit(0)).count() == 0
