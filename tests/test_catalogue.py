"""Catalogue queries on the smallest data against plain Python, where SQL can't check them."""

import hashlib
import json
import math
import re
from datetime import datetime

from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.plans import catalogue
from strandline.sources.tables import table


def redacted(text):
    for p in T.TOKEN_PATTERNS:
        text = re.sub(p, "[REDACTED]", text, flags=re.ASCII)
    text = re.sub(r"^([A-Z][A-Z0-9_]*)=(\S+)", r"\1=[REDACTED]", text, flags=re.ASCII | re.MULTILINE)

    def dense(m):
        r = m.group()
        bits = -sum(r.count(c) / len(r) * math.log2(r.count(c) / len(r)) for c in {*r})
        return "[REDACTED]" if re.search("[A-Za-z]", r) and re.search("[0-9]", r) and bits >= T.MIN_ENTROPY else r

    return re.sub(T.DENSE_RUN, dense, text)


def test_every_chunk_is_redacted(spark, tiny):
    chunks = {r.chunk_id: r.chunk_text for r in table(spark, tiny, "chunks").collect()}
    got = {r.chunk_id: r.clean for r in catalogue.queries()["i11_i12_redact"](spark, tiny).collect()}
    assert any(re.search(T.DENSE_RUN, t) for t in chunks.values() if t)
    assert got == {c: None if t is None else hashlib.md5(redacted(t).encode()).hexdigest() for c, t in chunks.items()}


def test_dense_runs_in_chunks(spark, tmp_path):
    texts = ["a q7Zr2Lk9Xw4Tb8Ns1Vd6Yp0Hc5Jg3 b", "TOKEN_A=q7Zr2Lk9Xw4Tb8Ns1Vd6Yp0Hc5Jg3\nsrc/app/handlers/requests_of_users", "plain", None, ""]
    spark.createDataFrame([*enumerate(texts)], "chunk_id long, chunk_text string").write.parquet(str(tmp_path / "chunks.parquet"))
    got = {r.chunk_id: r.clean for r in catalogue.queries()["i11_i12_redact"](spark, str(tmp_path)).collect()}
    want = ["a [REDACTED] b", "TOKEN_A=[REDACTED]\nsrc/app/handlers/requests_of_users", "plain", None, ""]
    assert got == {i: None if w is None else hashlib.md5(w.encode()).hexdigest() for i, w in enumerate(want)}


def patched(spark, d):
    """(message_id, action, path as written) of every file that a codex patch names."""
    kinds = {"Update File": "edit", "Add File": "create", "Delete File": "delete", "Move to": "rename"}
    out = []
    for r in table(spark, d, "log_lines").where("agent = 'codex'").collect():
        try:
            p = json.loads(r.raw_line)["payload"]
        except (ValueError, TypeError, KeyError):
            continue
        if isinstance(p, dict) and p.get("type") == "custom_tool_call" and p.get("name") == "apply_patch":
            out += [(r.line_id, kinds[m[1]], m[2].strip()) for m in re.finditer(r"^\*\*\* (Update File|Add File|Delete File|Move to): (.*?)\r?$", p["input"], re.MULTILINE)]
    return out


def test_touches_of_both_agents(spark, tiny):
    q = catalogue.queries()
    rows = q["a7d_b7_file_touches"](spark, tiny).collect()
    codex = [r for r in rows if r.session_id.startswith("codex:")]
    want = patched(spark, tiny)
    assert want and sorted((r.message_id, r.action) for r in codex) == sorted((i, a) for i, a, _ in want)
    said = {(i, a): {p for j, b, p in want if (j, b) == (i, a)} for i, a, _ in want}
    assert all(any(p.endswith(r.path) for p in said[r.message_id, r.action]) for r in codex)
    assert any(r.session_id.startswith("claude-code:") for r in rows)

    files = {}
    for r in rows:
        if r.action != "read":
            files.setdefault(r.session_id, set()).add(r.path)
    over = {r.session_id: r.files_changed for r in q["a10_session_overview"](spark, tiny).collect()}
    assert over == {s: len(files.get(s, ())) for s in over}
    assert any(n for s, n in over.items() if s.startswith("codex:"))

    hot = catalogue.A_FILE
    per = {s: [r.action for r in rows if r.session_id == s and r.path == hot] for s in over}
    per = {s: (",".join(sorted({*a})), len(a), sum(x != "read" for x in a)) for s, a in per.items() if a}
    touching = q["app6_sessions_touching"](spark, tiny).collect()
    assert len(touching) == min(20, len(per)) and all(per[r.session_id][:2] == (r.actions, r.touches) for r in touching)
    explained = q["app7_explain_file"](spark, tiny).collect()
    assert len(explained) == min(10, len(per)) and all(per[r.session_id] == (r.actions, r.touches, r.changes) for r in explained)


def test_a_file_that_both_agents_touch(spark, tmp_path):
    t = '{"timestamp": "2026-01-01T00:00:0%dZ", '
    raws = [
        (1, 1, "claude-code", 0, t % 0 + '"type": "assistant", "sessionId": "a", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "x", "name": "Read", "input": {"file_path": "/w/%s"}}]}}' % catalogue.A_FILE),
        (2, 2, "codex", 0, t % 1 + '"type": "session_meta", "payload": {"session_id": "b", "cwd": "/w"}}'),
        (3, 2, "codex", 1, t % 2 + '"type": "response_item", "payload": {"type": "custom_tool_call", "call_id": "c", "name": "apply_patch", "input": "*** Begin Patch\\n*** Update File: %s\\n*** Add File: g.py\\n*** End Patch"}}' % catalogue.A_FILE),
    ]
    at = datetime(2026, 1, 1)
    homes = [(f"{a}:{n}", a, n, 1, "/w", at, at, "t", 1) for a, n in (("claude-code", "a"), ("codex", "b"))]
    made = {
        "log_lines": spark.createDataFrame(raws, "line_id long, source_id long, agent string, line_no long, raw_line string").withColumn("ingested_at", F.lit(at)),
        "sessions": spark.createDataFrame(homes, "session_id string, agent string, native_id string, project_id long, cwd string, started_at timestamp, ended_at timestamp, title string, message_count long"),
        "projects": spark.createDataFrame([(1, "p")], "project_id long, project_name string"),
        "chunks": spark.createDataFrame([(5, "codex:b", 0, 3, "x")], "chunk_id long, session_id string, first_seq long, last_seq long, chunk_text string"),
    }
    for name, df in made.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    q, d = catalogue.queries(), str(tmp_path)
    assert {(r.session_id, r.path, r.action) for r in q["a7d_b7_file_touches"](spark, d).collect()} == {("claude-code:a", catalogue.A_FILE, "read"), ("codex:b", catalogue.A_FILE, "edit"), ("codex:b", "g.py", "create")}
    assert {(r.session_id, r.files_changed) for r in q["a10_session_overview"](spark, d).collect()} == {("claude-code:a", 0), ("codex:b", 2)}
    assert {(r.session_id, r.actions) for r in q["app6_sessions_touching"](spark, d).collect()} == {("claude-code:a", "read"), ("codex:b", "edit")}
    assert [(r.session_id, r.changes, r.chunk_id) for r in q["app7_explain_file"](spark, d).collect()] == [("codex:b", 1, 5), ("claude-code:a", 0, None)]
