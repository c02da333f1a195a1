"""Conversations against a plain in-memory version."""

import json
import random
from collections import defaultdict

import pytest

from strandline.llm import conversations as C
from strandline.llm.components import connected_components
from strandline.llm.loglines import decode, instant
from strandline.sources.tables import table

SCHEMA = "line_id long, agent string, line_no long, raw_line string"


def brute(rows):
    """rows: (line_id, agent, line_no, raw_line) -> the session ids to be dropped."""
    seen, msgs = set(), defaultdict(dict)
    bad = set()
    for _, agent, no, raw in rows:
        o = decode(raw) if agent == "claude-code" else None
        if o is None or not isinstance(o.get("sessionId"), str) or not o["sessionId"]:
            continue
        sid = o["sessionId"]
        seen.add(sid)
        m = o.get("message")
        if not isinstance(m, dict):
            continue
        t = instant(o.get("timestamp"))
        if t is None or m.get("role") not in ("user", "assistant"):
            bad.add(sid)
            if t is None:
                continue
        key = (t, json.dumps([m.get("role"), m.get("content")], sort_keys=True))
        old = msgs[sid].get(key)
        if old is None or no < old[0]:
            msgs[sid][key] = (no, m)
    for sid in seen - bad:
        order = sorted(((k[0], v[0], v[1]) for k, v in msgs[sid].items()), key=lambda x: x[:2])
        kinds = []
        calls, results = {}, []
        for k, (t, no, m) in enumerate(order):
            c = m.get("content")
            text = bool(c.strip()) if isinstance(c, str) else any(b.get("type") == "text" and str(b.get("text") or "").strip() for b in (c or []) if isinstance(b, dict))
            kinds.append({"user": "P", "assistant": "R"}[m["role"]] if text else "O")
            for b in c if isinstance(c, list) else []:
                if isinstance(b, dict) and b.get("type") == "tool_use":
                    calls.setdefault(b.get("id"), (t, no))
                if isinstance(b, dict) and b.get("type") == "tool_result":
                    results.append((b.get("tool_use_id"), (t, no)))
        spoken = [k for k in kinds if k != "O"]
        if "P" not in spoken or "R" not in spoken or kinds[0] != "P" or spoken[-1] == "P" or any(a == b == "P" for a, b in zip(spoken, spoken[1:])):
            bad.add(sid)
        if any(i is None or i not in calls or calls[i] >= w for i, w in results) or {*calls} - {i for i, _ in results}:
            bad.add(sid)
    return bad


def line(sid, role, at, content, **more):
    return json.dumps({"type": role, "sessionId": sid, "timestamp": at, "message": {"role": role, "content": content}} | more)


def frame(spark, raws):
    rows = [(i, "claude-code", i, r) for i, r in enumerate(raws)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    lines = table(spark, f"/root/testdata/{sf}", "log_lines")
    rows = [tuple(r) for r in lines.select("line_id", "agent", "line_no", "raw_line").collect()]
    got = [r[0] for r in C.dropped_sessions(lines).collect()]
    assert len(got) == len({*got}) and {*got} == brute(rows)


def test_cases(spark):
    t = "2026-01-01T00:00:0%dZ"
    use, res = [{"type": "tool_use", "id": "a", "name": "x", "input": {}}], [{"type": "tool_result", "tool_use_id": "a", "content": "ok"}]
    raws = [
        line("good", "user", t % 0, "hi"), line("good", "assistant", t % 1, use), line("good", "user", t % 2, res), line("good", "assistant", t % 3, "yes"),
        line("good", "user", "2026-01-01T01:00:00+01:00", "hi"),  # a copy in another notation
        line("noreply", "user", t % 0, "hi"), line("first", "assistant", t % 0, "hi"), line("first", "user", t % 1, "a"), line("first", "assistant", t % 2, "b"),
        line("end", "user", t % 0, "hi"), line("end", "assistant", t % 1, "b"), line("end", "user", t % 2, "c"),
        line("two", "user", t % 0, "hi"), line("two", "user", t % 1, "b"), line("two", "assistant", t % 2, "c"),
        line("early", "user", t % 0, "hi"), line("early", "user", t % 1, res), line("early", "assistant", t % 2, use), line("early", "assistant", t % 3, "c"),
        line("open", "user", t % 0, "hi"), line("open", "assistant", t % 2, use), line("open", "assistant", t % 3, "c"),
        line("blank", "user", t % 0, " \n"), line("blank", "assistant", t % 1, "c"),
        line("role", "user", t % 0, "hi"), line("role", "bot", t % 1, "x"), line("role", "assistant", t % 2, "c"),
        line("time", "user", t % 0, "hi"), line("time", "assistant", "yesterday", "c"), line("time2", "user", None, "hi"),
        json.dumps({"type": "mode", "sessionId": "only"}), "not json", "", None, "[]", '{"sessionId":"cut',
        json.dumps({"sessionId": "odd", "message": {"role": "user", "content": [None, 3, {"type": "text"}]}, "timestamp": t % 0}),
    ]
    df, rows = frame(spark, raws)
    got = {r[0] for r in C.dropped_sessions(df.withColumn("sid", df.line_id).withColumn("conv", df.line_id)).collect()}
    assert got == brute(rows) == {"noreply", "first", "end", "two", "early", "open", "blank", "role", "time", "time2", "only", "odd"}
    talk = C.conversations(df).orderBy("seq").collect()
    assert [(r.conversation_id, r.seq, r.role) for r in talk] == [("good", 0, "prompt"), ("good", 1, "tool"), ("good", 2, "tool"), ("good", 3, "reply")]


def test_empty(spark):
    assert C.dropped_sessions(spark.createDataFrame([], SCHEMA)).count() == 0
    assert C.conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hot_session(spark):
    raws = []
    for k in range(3000):
        raws += [line("hot", "user", f"2026-01-01T{k // 3600:02}:{k // 60 % 60:02}:{k % 60:02}.1Z", f"q{k}"), line("hot", "assistant", f"2026-01-01T{k // 3600:02}:{k // 60 % 60:02}:{k % 60:02}.5Z", f"a{k}")]
    df, _ = frame(spark, raws)
    assert C.dropped_sessions(df).count() == 0
    seqs = [r.seq for r in C.conversations(df).select("seq").orderBy("seq").collect()]
    assert seqs == [*range(6000)]
    df, _ = frame(spark, [*raws, line("hot", "user", "2026-01-01T00:30:00.2Z", "again")])
    assert [r[0] for r in C.dropped_sessions(df).collect()] == ["hot"]


def test_messages_without_a_session(spark):
    def bare(role, at, content):
        return json.dumps({"timestamp": at, "message": {"role": role, "content": content}})

    t = "2026-01-01T00:00:0%dZ"
    use = lambda i: {"type": "tool_use", "id": i}
    res = lambda i: {"type": "tool_result", "tool_use_id": i, "content": "ok"}
    raws = [
        line("s1", "user", t % 0, "hi"), line("s1", "assistant", t % 1, [use("a")]), bare("user", t % 2, [res("a")]), line("s1", "assistant", t % 3, "done"),
        bare("user", t % 0, [{"type": "text", "text": "q"}, res("z")]), bare("assistant", t % 1, [use("z"), {"type": "text", "text": "r"}]),
    ]
    df, _ = frame(spark, raws)
    facts = C.merged_facts(df)
    of = {r.conv for r in facts.where("sid is null").collect()}
    assert of == {"s:s1", "x:" + "4".rjust(20, "0")}
    assert C.dropped_sessions(df).count() == 0


def test_components_match_union_find(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2060)] + [(5, 5), (None, 3)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_messages_come_out_whole(spark):
    t = "2026-01-01T00:00:0%dZ"
    said = [
        ("user", "hé\ud800" + '"\n'), ("assistant", [{"type": "thinking", "thinking": "hm"}]), ("assistant", [{"type": "tool_use", "id": "a", "name": "x", "input": {"n": 1.5}}]),
        ("user", [{"type": "tool_result", "tool_use_id": "a", "content": "ok"}]), ("assistant", [{"type": "text", "text": "yes"}]),
    ]
    raws = ["", *(line("good", role, t % k, content) for k, (role, content) in enumerate(said)), line("good", *("user", "2026-01-01T01:00:00+01:00", said[0][1]))]
    df, _ = frame(spark, raws)
    got = C.conversations(df).orderBy("seq").collect()
    assert [(r.seq, r.line_id, r.line_no, r.speaker, r.kind) for r in got] == [(0, 1, 1, "user", "text"), (1, 2, 2, "assistant", "thinking"), (2, 3, 3, "assistant", "tool_use"), (3, 4, 4, "user", "tool_result"), (4, 5, 5, "assistant", "text")]
    assert [json.loads(r.message) for r in got] == [{"role": role, "content": content} for role, content in said]


def test_query_gives_role_kind_line_and_message(spark, tiny):
    from strandline.llm import queries

    raw = {r.line_id: json.loads(r.raw_line)["message"] for r in table(spark, tiny, "log_lines").collect() if (decode(r.raw_line) or {}).get("message")}
    rows = queries.p1_conversations(spark, tiny).collect()
    assert rows and all(json.loads(r.message) == raw[r.line_id] and r.role == raw[r.line_id]["role"] for r in rows)
    assert {"text", "tool_use", "tool_result"} <= {r.kind for r in rows}


def test_reply_links(spark):
    """Messages without a session come together over parentUuid, tool ids and both."""

    def bare(at, content, **more):
        return json.dumps({"timestamp": f"2026-01-01T00:00:0{at}Z", "message": {"role": "user", "content": content}} | more)

    use, res = [{"type": "tool_use", "id": "a"}], [{"type": "tool_result", "tool_use_id": "a", "content": "ok"}]
    raws = [
        bare(0, "q", uuid="u0"), bare(1, use, uuid="u1", parentUuid="u0"), bare(2, res), bare(3, "end", parentUuid="u1"),
        line("s1", "user", "2026-01-01T00:00:04Z", "hi", uuid="v0"), bare(5, "other", parentUuid="v0"), bare(6, "alone"), bare(7, "odd", uuid=3, parentUuid=None), "x", None,
        bare(8, "a"), bare(9, "b", parentUuid="a"),  # a tool's id is no line's name
    ]
    df, _ = frame(spark, raws)
    facts = C.merged_facts(df).where(f"fact = {C.MESSAGE}").collect()
    of = {r.line_id: r.conv for r in facts}
    x = lambda n: "x:" + str(n).rjust(20, "0")
    assert of == {0: x(0), 1: x(0), 2: x(0), 3: x(0), 4: "s:s1", 5: "s:s1", 6: x(6), 7: x(7), 10: x(10), 11: x(11)}
    got = {r.line_id: r.conversation_id for r in C.linked_conversations(df).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6, 7: 7, 10: 10, 11: 11}
    assert C.linked_conversations(df.limit(0)).count() == 0


def test_links_alone_never_join_two_sessions(spark):
    """On the test data the tool ids tell sessions apart, and the components are found by them."""
    lines = table(spark, "/root/testdata/sf0.01", "log_lines")
    sid = {r.line_id: (decode(r.raw_line) or {}).get("sessionId") for r in lines.where("agent = 'claude-code'").collect()}
    groups = defaultdict(set)
    for r in C.linked_conversations(lines).collect():
        groups[r.conversation_id].add(r.line_id)
    assert all(min(g) == c for c, g in groups.items())
    assert sum(len({sid[i] for i in g}) > 1 for g in groups.values()) <= 0.01 * len(groups)
    assert sum(len(g) > 1 for g in groups.values()) > 200
