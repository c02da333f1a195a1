"""Problem 1: rebuilding conversations from message rows.

1. Every line is read once and becomes narrow facts: sightings of a session,
   messages with their order and kind, tool calls and tool results. Copies of a
   fact are merged by one aggregation, whose result is cut; all later steps read
   that.
2. Messages that carry no session id get one from the graph of reply and quote
   links (tool_use id to tool_use_id, parentUuid to uuid): its connected components,
   found by alternating large-star and small-star joins, are the conversations.
   ``linked_conversations`` does that for all messages, whatever ids they carry.
3. Order is checked without ever holding a conversation in one task: prompts and
   replies are range-partitioned by (conversation, instant, line), each Arrow batch
   yields one segment summary per conversation in it (first kind, last kind, broken
   inside), and each segment and the next one of its conversation decide. A conversation of any size is
   spread over as many tasks as its rows need.
4. Tool links are aggregates over (conversation, tool id), everything else over the
   conversation; all of them combine on the map side.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import cut

from .components import connected_components
from .loglines import clean, decode, instant, slices

#: Kinds of facts.
SEEN, MESSAGE, CALL, RESULT, NAMED = 0, 1, 2, 3, 4
#: Kinds of messages: with text of the user, of the assistant, without text.
OTHER, PROMPT, REPLY = 0, 1, 2
FACTS = "sid string, own long, fact int, sub string, instant long, line_no long, line_id long, kind int, bad boolean"


def _kind(role: object, content: object) -> int:
    if isinstance(content, str):
        text = bool(content.strip())
    else:
        text = isinstance(content, list) and any(isinstance(b, dict) and b.get("type") == "text" and isinstance(b.get("text"), str) and b["text"].strip() for b in content)
    return (PROMPT if role == "user" else REPLY if role == "assistant" else OTHER) if text else OTHER


def message_facts(lines: DataFrame, sessions: bool = True) -> DataFrame:
    """Facts of claude-code lines. ``own`` is the line's id where it has no session id;
    without ``sessions`` none has."""
    import pyarrow as pa

    kinds = [("sid", pa.string()), ("own", pa.int64()), ("fact", pa.int32()), ("sub", pa.string()), ("instant", pa.int64()), ("line_no", pa.int64()), ("line_id", pa.int64()), ("kind", pa.int32()), ("bad", pa.bool_())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2000):
                out: list[tuple] = []
                seen: set[str] = set()
                for line_id, line_no, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    o = decode(raw)
                    if o is None:
                        continue
                    sid = o.get("sessionId")
                    sid = clean(sid) if sessions and isinstance(sid, str) and sid else None
                    own = None if sid else line_id
                    if sid and sid not in seen:
                        seen.add(sid)
                        out.append((sid, None, SEEN, None, None, None, None, None, False))
                    m = o.get("message")
                    if not isinstance(m, dict):
                        continue
                    role, content, at = m.get("role"), m.get("content"), instant(o.get("timestamp"))
                    whose = hashlib.md5(json.dumps([role, content], sort_keys=True).encode()).hexdigest()[:24]
                    out.append((sid, own, MESSAGE, whose, at, line_no, line_id, _kind(role, content), at is None or role not in ("user", "assistant")))
                    for name in (o.get("uuid"), o.get("parentUuid")):
                        if isinstance(name, str) and name:
                            out.append((sid, own, NAMED, clean(name), at, line_no, line_id, None, False))
                    for c in content if isinstance(content, list) else ():
                        if isinstance(c, dict) and c.get("type") in ("tool_use", "tool_result"):
                            call = c["type"] == "tool_use"
                            tool = c.get("id" if call else "tool_use_id")
                            tool = clean(tool) if isinstance(tool, str) else None
                            out.append((sid, own, CALL if call else RESULT, tool, at, line_no, line_id, None, tool is None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out) if out else [[]] * len(kinds), kinds)], schema=schema)

    return lines.where(F.col("agent") == "claude-code").select("line_id", "line_no", "raw_line").mapInArrow(run, FACTS)


def _named(facts: DataFrame) -> DataFrame:
    """Facts with ``conv``: the session id, or for messages without one the session (or
    else the least line) of their component over reply and quote links."""
    known = facts.where("sid is not null").withColumn("conv", F.concat(F.lit("s:"), "sid"))
    lost = facts.where("sid is null")
    if lost.isEmpty():
        return known
    # one vertex for each tool id and line name, so that copies of an id don't make pairs
    linked = F.col("fact").isin(CALL, RESULT, NAMED) & F.col("sub").isNotNull()
    link = F.concat(F.when(F.col("fact") == NAMED, "u:").otherwise("t:"), F.col("sub"))
    own = F.concat(F.lit("x:"), F.lpad(F.col("own").cast("string"), 20, "0"))
    links = lost.where(linked).select(link.alias("b")).distinct()
    node = F.when(F.col("sid").isNull(), own).otherwise(F.concat(F.lit("s:"), "sid"))
    ends = facts.where(linked).select(node.alias("a"), link.alias("b")).join(links.hint("merge"), "b").select("a", "b").distinct()
    found = connected_components(ends).where("vertex like 'x:%' or vertex like 's:%'")
    # a component is named by its least session, or by its least line if it has none
    named = found.groupBy("component").agg(F.min("vertex").alias("conv"))
    of = found.where("vertex like 'x:%'").join(named.hint("merge"), "component").select("vertex", "conv")
    placed = lost.withColumn("vertex", own).join(of.hint("merge"), "vertex", "left").withColumn("conv", F.coalesce("conv", "vertex")).drop("vertex")
    return known.unionByName(placed)


def merged_facts(lines: DataFrame, sessions: bool = True) -> DataFrame:
    """One row for each fact of a conversation, its copies merged; computed once."""
    facts = message_facts(lines, sessions)
    # the copy that stands first; one without a line_no only if there is no other
    first = F.min(F.struct(F.col("line_no").isNull().alias("none"), "line_no", "line_id"))
    merged = facts.groupBy("sid", "own", "fact", "sub", "instant").agg(first.alias("at"), F.max("kind").alias("kind"), F.max("bad").alias("bad"))
    return _named(cut(merged.select("sid", "own", "fact", "sub", "instant", "at.line_no", "at.line_id", "kind", "bad")))


def order_breaks(facts: DataFrame) -> DataFrame:
    """``conv`` of every conversation with a prompt that no reply follows before the
    next prompt or the end."""
    import pyarrow as pa

    spoken = facts.where((F.col("fact") == MESSAGE) & F.col("kind").isin(PROMPT, REPLY) & F.col("instant").isNotNull()).select("conv", "instant", "line_no", "sub", "kind")
    ordered = spoken.repartitionByRange("conv", "instant", "line_no", "sub").sortWithinPartitions("conv", "instant", "line_no", "sub")
    names = ["conv", "instant", "line_no", "sub", "first", "last", "broken"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            if not b.num_rows:
                continue
            conv = b.column(0).dictionary_encode()
            code, kind = np.asarray(conv.indices), b.column(4).to_numpy()
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            ends = np.r_[starts[1:], len(code)]
            bad = np.r_[(code[1:] == code[:-1]) & (kind[1:] == PROMPT) & (kind[:-1] == PROMPT), False]
            broken = np.add.reduceat(bad.astype(int), starts) > 0
            first = b.take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([*(first.column(i) for i in range(4)), pa.array(kind[starts], pa.int32()), pa.array(kind[ends - 1], pa.int32()), pa.array(broken)], names)

    segments = ordered.mapInArrow(run, "conv string, instant long, line_no long, sub string, first int, last int, broken boolean")
    following = Window.partitionBy("conv").orderBy("instant", "line_no", "sub")  # of segments: a row for an Arrow batch
    ends = segments.withColumn("next", F.lead("first").over(following))
    return ends.where(F.col("broken") | ((F.col("last") == PROMPT) & F.coalesce(F.col("next") == PROMPT, F.lit(True)))).select("conv")


def link_breaks(facts: DataFrame) -> DataFrame:
    """``conv`` of every conversation with a result before or without its call, or a call
    without a result."""
    when = F.struct("instant", "line_no")
    per = (
        facts.where(F.col("fact").isin(CALL, RESULT))
        .groupBy("conv", "sub")
        .agg(
            F.min(F.when(F.col("fact") == CALL, when)).alias("call"),
            F.min(F.when(F.col("fact") == RESULT, when)).alias("result"),
        )
    )
    return per.where(F.col("sub").isNull() | F.col("call").isNull() | F.col("result").isNull() | (F.col("call") >= F.col("result"))).select("conv")


def broken_conversations(facts: DataFrame) -> DataFrame:
    """``conv`` of every conversation to be dropped."""
    spoken = F.col("fact") == MESSAGE
    whole = facts.groupBy("conv").agg(
        F.count_if(spoken & (F.col("kind") == PROMPT)).alias("prompts"),
        F.count_if(spoken & (F.col("kind") == REPLY)).alias("replies"),
        F.min(F.when(spoken & F.col("instant").isNotNull(), F.struct("instant", "line_no", "kind"))).alias("first"),
        F.max(F.when(spoken, F.col("bad")).otherwise(False)).alias("bad"),
    )
    own = whole.where((F.col("prompts") == 0) | (F.col("replies") == 0) | F.col("bad") | (F.coalesce(F.col("first.kind"), F.lit(OTHER)) != PROMPT)).select("conv")
    return own.unionByName(order_breaks(facts)).unionByName(link_breaks(facts)).distinct()


def dropped_sessions(lines: DataFrame) -> DataFrame:
    """``native_id``: the session ids of the conversations to be dropped.

    Invalid, empty and null lines are ignored, copies of a message count once, a
    null line_no sorts first, ties of instant go by line_no and then by content, a
    session without messages is a case, an empty table gives an empty one. Columns
    other than line_id, line_no, agent and raw_line are not read.
    """
    return broken_conversations(merged_facts(lines)).where("conv like 's:%'").select(F.substring("conv", 3, 1 << 30).alias("native_id"))


def _content_kind(content: object) -> str:
    """text, tool_use, tool_result, thinking, or other where a message has none of these."""
    if _kind("user", content) == PROMPT:
        return "text"
    types = {b.get("type") for b in content if isinstance(b, dict) and isinstance(b.get("type"), str)} if isinstance(content, list) else set()
    return next((t for t in ("tool_use", "tool_result", "thinking") if t in types), "other")


def _as_json(message: dict) -> str:
    """The message as JSON; lone surrogates, which no column can hold, stay escapes."""
    said = json.dumps(message, ensure_ascii=False)
    return said if clean(said) == said else json.dumps(message)


def _with_messages(numbered: DataFrame, lines: DataFrame) -> DataFrame:
    """``numbered`` with the role, kind and JSON of each row's message, read from its line."""
    import pyarrow as pa

    found = numbered.join(lines.where(F.col("agent") == "claude-code").select("line_id", "raw_line").hint("merge"), "line_id")
    names = ["conversation_id", "seq", "role", "instant", "line_no", "line_id", "message_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 2000):
                said = [decode(raw)["message"] for raw in b.column(len(names)).to_pylist()]
                more = [[m["role"] for m in said], [_content_kind(m.get("content")) for m in said], [_as_json(m) for m in said]]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], *(pa.array(c, pa.string()) for c in more)], [*names, "speaker", "kind", "message"])

    return found.select(*names, "raw_line").mapInArrow(run, "conversation_id string, seq long, role string, instant long, line_no long, line_id long, message_hash string, speaker string, kind string, message string")


def conversations(lines: DataFrame) -> DataFrame:
    """The sound conversations as ordered messages: conversation_id, seq (from 0), role
    (the message's part: prompt, reply, or tool for one without text), instant
    (microseconds), line_no and line_id of the first copy, message_hash, speaker
    (message.role: user or assistant), kind (text, tool_use, tool_result, thinking,
    other) and message (the JSON of that line's message).

    ``seq`` comes from segment offsets, so also here no conversation is held in one
    task. The messages themselves are joined back at the end, by line_id. The same rules
    as in ``dropped_sessions``.
    """
    import pyarrow as pa

    facts = merged_facts(lines)
    broken = broken_conversations(facts)
    kept = facts.where(F.col("fact") == MESSAGE).join(broken.hint("merge"), "conv", "left_anti").select("conv", "instant", "line_no", "sub", "kind", "line_id")
    ordered = kept.repartitionByRange("conv", "instant", "line_no", "sub").sortWithinPartitions("conv", "instant", "line_no", "sub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 32
        for k, b in enumerate(batches):
            if not b.num_rows:
                continue
            code = np.asarray(b.column(0).dictionary_encode().indices)
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            place = np.arange(len(code)) - np.repeat(starts, np.diff(np.r_[starts, len(code)]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(code), part + k)), pa.array(place)], ["conv", "instant", "line_no", "sub", "kind", "line_id", "segment", "place"])

    placed = cut(ordered.mapInArrow(run, "conv string, instant long, line_no long, sub string, kind int, line_id long, segment long, place long"))
    sizes = placed.groupBy("conv", "segment").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("conv", "segment", (F.sum("n").over(Window.partitionBy("conv").orderBy("segment")) - F.col("n")).alias("before"))
    numbered = placed.join(before.hint("merge"), ["conv", "segment"]).withColumn("seq", F.col("before") + F.col("place"))
    role = F.when(F.col("kind") == PROMPT, "prompt").when(F.col("kind") == REPLY, "reply").otherwise("tool")
    numbered = numbered.select(F.substring("conv", 3, 1 << 30).alias("conversation_id"), F.col("seq").cast("long").alias("seq"), role.alias("role"), "instant", "line_no", "line_id", F.col("sub").alias("message_hash"))
    return _with_messages(numbered, lines)


def linked_conversations(lines: DataFrame) -> DataFrame:
    """(line_id, conversation_id): every message and the conversation that its links alone
    put it into, whatever session id it carries; a conversation is named by its least line.

    A message without links is a conversation of its own; invalid, empty and null lines
    are none; repeated lines share their links; null line_ids are left out; an empty table
    gives an empty one. Only line_id, line_no, agent and raw_line are read.
    """
    facts = merged_facts(lines.where("line_id is not null"), sessions=False)
    return facts.where(F.col("fact") == MESSAGE).select(F.col("own").alias("line_id"), F.substring("conv", 3, 20).cast("long").alias("conversation_id"))
