"""Streams give what the batch gives."""

import json
import logging

from strandline.operators import transcript
from strandline.sources import adapters, jsonl
from strandline.sources.embedding import HashEmbedder
from strandline.streaming import drain, ingest, turns


def line(i, role, text):
    return json.dumps({"type": role, "sessionId": "s", "timestamp": f"2026-01-01T00:00:{i:02}Z", "message": {"role": role, "content": text}})


def test_tail_source(spark, tmp_path):
    jsonl.register(spark)
    root = tmp_path / "logs"
    root.mkdir()
    f = root / "a.jsonl"

    def run(name):
        q = spark.readStream.format("jsonl_tail").load(str(root)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(40), name
        finally:
            q.stop()
        return sorted((r.byte_offset, r.raw_line) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    f.write_text('{"a":1}\n{"b"')
    assert run("first") == [(0, '{"a":1}')]
    f.write_text('{"a":1}\n{"b":2}\n')
    assert run("second") == [(0, '{"a":1}'), (8, '{"b":2}')]


def test_batches(spark, tmp_path):
    store = ingest.LogStore(spark, str(tmp_path / "store"))

    def batch(n, lines, at=0):
        rows = []
        for x in lines:
            rows.append(("/logs/a.jsonl", at, x))
            at += len(x) + 1
        ingest.handle_batch(store, spark.createDataFrame(rows, "log_path string, byte_offset long, raw_line string"), n)
        return at

    at = batch(0, [line(0, "user", "q1"), line(1, "assistant", "a1")])
    for _ in range(2):  # a batch that is run again changes nothing
        batch(1, [line(2, "user", "q2"), line(3, "assistant", "a2")], at)
        assert [(r.seq, r.content) for r in store.messages().orderBy("seq").collect()] == [(0, "q1"), (1, "a1"), (2, "q2"), (3, "a2")]
    assert [(r.first_seq, r.last_seq) for r in store.chunks().orderBy("first_seq").collect()] == [(0, 1), (2, 3)]
    batch(2, [line(0, "user", "new"), line(1, "assistant", "b")])  # rewritten: its rows are replaced
    assert [r.content for r in store.messages().orderBy("seq").collect()] == ["new", "b"]


def batch_result(spark, root):
    """(session_id, seq, role, kind, content) of all files as one batch gives them."""
    rows = []
    for k, f in enumerate(sorted(root.rglob("*.jsonl"))):
        at = 0
        for raw in f.read_text().split("\n")[:-1]:
            if raw.strip():
                rows.append((len(rows), k + 1, ingest.agent_of(str(f)), at, raw))
            at += len(raw.encode()) + 1
    lines = spark.createDataFrame(rows, "line_id long, source_id long, agent string, line_no long, raw_line string")
    m = transcript.messages(adapters.parse(lines)).persist()
    return sorted((r.session_id, r.seq, r.role, r.kind, r.content) for r in m.collect()), sorted(tuple(r) for r in transcript.chunks(m).collect())


def codex(i, kind, **payload):
    return json.dumps({"timestamp": f"2026-01-01T00:00:{i:02}Z", "type": kind, "payload": payload})


def said(i, role, text):
    return codex(i, "response_item", type="message", role=role, content=[{"type": "input_text", "text": text}])


def test_follow_gives_what_the_batch_gives(spark, tmp_path):
    root = tmp_path / "logs"
    (root / "codex").mkdir(parents=True)
    store = ingest.LogStore(spark, str(tmp_path / "store"))
    a, b, c = root / "a.jsonl", root / "b.jsonl", root / "codex" / "c.jsonl"

    def run():
        q = ingest.follow(spark, str(root), store, str(tmp_path / "cp"), once=True)
        try:
            assert q.awaitTermination(120)
        finally:
            q.stop()
        got = sorted((r.session_id, r.seq, r.role, r.kind, r.content) for r in store.messages().collect())
        want, chunks = batch_result(spark, root)
        assert got == want and got
        assert sorted(tuple(r) for r in store.chunks().select("session_id", "first_seq", "last_seq", "chunk_text").collect()) == chunks

    def add(f, *lines):
        with f.open("a") as out:
            out.write("".join(x + "\n" for x in lines))

    add(a, line(0, "user", "q1"), line(1, "assistant", "a1"), "not json")
    add(c, codex(0, "session_meta", session_id="n1", cwd="/w"), said(1, "user", "hello"))
    run()
    # the session goes on in a second file, and the other one without its first line
    add(b, line(2, "user", "q2"), line(3, "assistant", "a2"))
    add(c, said(2, "assistant", "hi"), said(3, "user", "more"))
    run()
    add(a, line(4, "user", "q3"))
    add(c, codex(4, "session_meta", session_id="n2", cwd="/x"), said(5, "user", "another"))
    run()
    # a file is written anew: one session of it is gone, another one new
    c.write_text(codex(0, "session_meta", session_id="n3", cwd="/w") + "\n" + said(1, "user", "anew") + "\n")
    run()
    assert {r.session_id for r in store.messages().collect()} == {"claude-code:s", "codex:n3"}
    rows = {r.log_path.rsplit("/", 1)[-1]: r for r in ingest.report(store).collect()}
    assert rows["a.jsonl"].failed == 1 and rows["a.jsonl"].last_error == "invalid JSON" and rows["b.jsonl"].messages == 2
    assert len({r.source_id for r in store.sources().collect()}) == 3


def test_spans_and_addresses(spark, tmp_path, monkeypatch):
    f = tmp_path / "x" / "big.jsonl"
    f.parent.mkdir()
    lines = ['{"n": %d, "t": "%s"}' % (i, "é" * (i % 40)) for i in range(500)]
    f.write_text("\n".join(lines) + "\n{}")
    for span in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(jsonl, "SPAN", span)
        for root in (str(tmp_path), f"file://{tmp_path}"):
            reader = jsonl._Batch(root)
            got = sorted(x for p in reader.partitions() for x in reader.read(p)) if span > 1 or root[0] == "/" else None
            if got is not None:
                assert [x[2] for x in got] == lines and all(x[0].endswith("big.jsonl") for x in got)
                assert [x[1] for x in got] == [sum(len(y.encode()) + 1 for y in lines[:k]) for k in range(len(lines))]
    assert jsonl.scan(spark, f"file://{tmp_path}").count() == 501 == jsonl.scan(spark, str(tmp_path)).count()
    assert jsonl.scan(spark, f"file://{tmp_path}/nothing").count() == 0


def test_settled_turns(spark, tmp_path):
    rows = [("s", 0, "user", "text", "q1"), ("s", 1, "assistant", "text", "a1"), ("s", 2, "user", "text", "q2"), ("s", 3, "system", "event", "x"), ("s", 4, "assistant", "text", "a2"), ("s", 5, "user", "text", "q3"), ("t", 0, "user", "text", "only")]
    schema = "session_id string, seq long, role string, kind string, content string"
    src = tmp_path / "in"
    for part in (rows[:3], rows[3:5], rows[5:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = turns.settled_turns(stream).writeStream.format("memory").queryName("turns").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    got = {tuple(r) for r in spark.table("turns").collect()}
    want = {tuple(r) for r in transcript.chunks(spark.createDataFrame(rows, schema), eager_tail=False).collect()}
    assert got == want and len(want) == 2


def test_drain(spark, caplog):
    c = spark.createDataFrame([(i, "s", "text %d" % i) for i in range(7)] + [(99, "none", "x")], "chunk_id long, session_id string, chunk_text string")
    s = spark.createDataFrame([("s", 1, "g"), ("none", None, "g")], "session_id string, project_id long, agent string")
    vectors = [spark.createDataFrame([], "chunk_id long, project_id long, agent string, embedding array<float>, session_id string")]

    def step():
        rows = drain.embed_batch(c, s, vectors[0], lambda: HashEmbedder(8), 3).collect()
        vectors[0] = vectors[0].union(spark.createDataFrame(rows, vectors[0].schema))
        return len(rows)

    assert drain.drain(step) == 7 and vectors[0].count() == 7
    calls = iter([RuntimeError("down"), RuntimeError("down"), 2, 0])

    def flaky():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    with caplog.at_level(logging.INFO):
        drain.Loop(flaky, sleep=lambda _: None).run(3)
    assert [m for m in caplog.messages if "embedding" in m] == ["embedding failed: down", "embedding works again"]
