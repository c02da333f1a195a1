"""All queries of the core and their SQL, by name.

Each entry runs an operator over whole tables of the data folder; the SQL says the same
independently, in DuckDB's dialect.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.functions import vectors as V
from strandline.operators import fulltext, ordered, schema_drift, store, transcript, vector_search
from strandline.schemas import violations
from strandline.session import cut
from strandline.sources import adapters
from strandline.sources.tables import table

from . import named

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


# -- views over the data folder ------------------------------------------------------------------
def parsed(spark: SparkSession, d: str) -> DataFrame:
    return adapters.parse(table(spark, d, "log_lines"))


def msgs(spark: SparkSession, d: str, content: bool = True) -> DataFrame:
    """Messages of lines that are parsed once: they are read for the rows and for the calls
    that results look up, and parsing is most of the work. Without ``content`` it is null."""
    rows = parsed(spark, d).where("status = 'message'")
    return transcript.messages(cut(rows if content else rows.withColumn("content", F.lit(None).cast("string"))))


def sess(spark: SparkSession, d: str) -> DataFrame:
    """Sessions with times as ISO text, which is how log messages have theirs."""
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    return table(spark, d, "sessions").withColumn("started_at", F.date_format("started_at", iso)).withColumn("ended_at", F.date_format("ended_at", iso))


def touches(spark: SparkSession, d: str) -> DataFrame:
    return transcript.file_touches(msgs(spark, d, content=False), table(spark, d, "sessions").select("session_id", "project_id", "cwd"))


def chunk_index(spark: SparkSession, d: str) -> fulltext.Index:
    return fulltext.index_of(table(spark, d, "chunks").select("chunk_id", "chunk_text"), f"{d}/chunks")


def doc_index(spark: SparkSession, d: str) -> fulltext.Index:
    return fulltext.index_of(table(spark, d, "documents").select("doc_id", "text"), f"{d}/documents", "doc_id", "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vector table: a chunk's least usable response, with its session's scope."""
    r = table(spark, d, "embed_responses").where((F.size("embeddings") == 1)).select("response_id", "chunk_id", F.element_at("embeddings", 1).alias("embedding"))
    r = r.where((F.size("embedding") == 64) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0))
    one = r.groupBy("chunk_id").agg(F.min_by("embedding", "response_id").alias("embedding"))
    c = table(spark, d, "chunks").select("chunk_id", "session_id")
    return one.join(c, "chunk_id").join(table(spark, d, "sessions").select("session_id", "project_id", "agent"), "session_id")


def redact_sql(x: str) -> str:
    """A text redacted, in SQL: token shapes, environment lines, then dense runs piece by piece."""
    for p in T.TOKEN_PATTERNS:
        x = f"regexp_replace({x}, '{p}', '[REDACTED]', 'g')"
    x = f"regexp_replace({x}, '(?m)^([A-Z][A-Z0-9_]*)=(\\S+)', '\\1=[REDACTED]', 'g')"
    piece = "CASE WHEN length(r) >= 20 AND regexp_matches(r, '^[A-Za-z0-9+/_-]') AND regexp_matches(r, '[A-Za-z]') AND regexp_matches(r, '[0-9]') AND list_entropy(string_split(r, '')) >= 4.3 THEN '[REDACTED]' ELSE r END"
    return f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z0-9+/_-]{{20,}}|[A-Za-z0-9+/_-]{{1,19}}|[^A-Za-z0-9+/_-]+'), lambda r: {piece}), '')"


_STR = "CASE WHEN json_type({v}, '{p}') = 'VARCHAR' THEN {v}->>'{p}' END"


def _s(v: str, p: str) -> str:
    return _STR.format(v=v, p=p)


MESSAGES_SQL = f"""
j AS (SELECT line_id, source_id, agent, line_no, CASE WHEN json_valid(raw_line) THEN CAST(raw_line AS JSON) END AS v FROM log_lines WHERE trim(raw_line) <> ''),
c0 AS (SELECT *, {_s('v', '$.type')} AS t, json_type(v, '$.message.content') AS ct,
         CASE WHEN json_type(v, '$.message.content') = 'ARRAY' THEN v->'$.message.content[0]' END AS b FROM j WHERE agent = 'claude-code' AND json_type(v) = 'OBJECT'),
c1 AS (SELECT *, {_s('b', '$.type')} AS bt, {_s('v', '$.message.role')} AS r FROM c0),
c2 AS (SELECT line_id, source_id, agent, line_no, {_s('v', '$.sessionId')} AS native_id, {_s('v', '$.cwd')} AS cwd, {_s('v', '$.gitBranch')} AS git_branch,
         CASE WHEN t <> 'ai-title' AND t <> 'system' THEN {_s('v', '$.message.model')} END AS model, {_s('v', '$.timestamp')} AS created_at,
         CASE WHEN t = 'ai-title' THEN {_s('v', '$.aiTitle')} END AS title, t <> 'ai-title' AS made,
         CASE WHEN t = 'ai-title' THEN NULL WHEN t = 'system' THEN 'system' WHEN bt = 'tool_result' THEN 'tool' ELSE r END AS role,
         CASE WHEN t = 'ai-title' THEN NULL WHEN t = 'system' THEN 'event' WHEN ct = 'VARCHAR' THEN 'text'
              WHEN bt = 'tool_use' THEN 'tool_call' ELSE bt END AS kind,
         CASE WHEN bt = 'tool_use' THEN {_s('b', '$.name')} END AS tool_name,
         CASE WHEN bt = 'tool_use' THEN {_s('b', '$.id')} WHEN bt = 'tool_result' THEN {_s('b', '$.tool_use_id')} END AS tool_use_id,
         CASE WHEN t = 'system' THEN coalesce({_s('v', '$.content')}, '')
              WHEN ct = 'VARCHAR' THEN v->>'$.message.content' WHEN bt = 'text' THEN coalesce({_s('b', '$.text')}, '')
              WHEN bt = 'thinking' THEN coalesce({_s('b', '$.thinking')}, '') WHEN bt = 'tool_use' THEN NULL
              WHEN json_type(b, '$.content') = 'VARCHAR' THEN b->>'$.content'
              WHEN json_type(b, '$.content') = 'ARRAY' THEN array_to_string(list_transform(CAST(b->'$.content' AS JSON[]), lambda x: CASE WHEN x->>'$.type' = 'text' THEN coalesce(x->>'$.text', '') ELSE '[' || (x->>'$.type') || ' content omitted]' END), '')
              ELSE '' END AS said,
         CASE WHEN bt = 'tool_use' AND {_s('b', '$.name')} IN ('Read', 'Edit', 'MultiEdit', 'Write') THEN nullif({_s('b', '$.input.file_path')}, '') END AS touched
       FROM c1 WHERE t IN ('system', 'ai-title') OR (t IN ('user', 'assistant') AND json_type(v, '$.message') = 'OBJECT'
         AND (ct = 'VARCHAR' OR bt IN ('text', 'thinking', 'tool_use', 'tool_result')))),
x0 AS (SELECT *, {_s('v', '$.type')} AS t, {_s('v', '$.payload.type')} AS p FROM j WHERE agent = 'codex'),
x1 AS (SELECT *, last_value(CASE WHEN t = 'session_meta' THEN {_s('v', '$.payload.session_id')} END IGNORE NULLS) OVER w AS native_id,
         last_value(CASE WHEN t = 'session_meta' THEN coalesce({_s('v', '$.payload.cwd')}, '') WHEN t = 'turn_context' THEN nullif({_s('v', '$.payload.cwd')}, '') END IGNORE NULLS) OVER w AS cwd,
         v->>'$.payload.internal_chat_message_metadata_passthrough.content_item_kinds[0]' AS k0, {_s('v', '$.payload.role')} AS r,
         nullif({_s('v', '$.payload.error.message')}, '') AS failed
       FROM x0 WINDOW w AS (PARTITION BY source_id ORDER BY line_no, line_id ROWS UNBOUNDED PRECEDING)),
x2 AS (SELECT *, CASE WHEN t = 'response_item' AND p = 'message' THEN CASE WHEN r = 'assistant' THEN 'assistant' WHEN k0 IS NULL THEN CASE WHEN r = 'developer' THEN 'system' ELSE 'user' END WHEN k0 = 'user.text' THEN 'user' ELSE 'system' END END AS who
       FROM x1 WHERE json_type(v) = 'OBJECT' AND (t IN ('session_meta', 'turn_context')
         OR (t = 'response_item' AND ((p = 'message' AND json_array_length(v, '$.payload.content') > 0) OR p IN ('custom_tool_call', 'custom_tool_call_output') OR (p = 'reasoning' AND json_array_length(v, '$.payload.summary') > 0)))
         OR (t = 'event_msg' AND p = 'task_complete' AND failed IS NOT NULL))),
x3 AS (SELECT line_id, source_id, agent, line_no, native_id, cwd, CAST(NULL AS VARCHAR) AS git_branch, CASE WHEN t = 'turn_context' THEN {_s('v', '$.payload.model')} END AS model,
         {_s('v', '$.timestamp')} AS created_at, CAST(NULL AS VARCHAR) AS title, t NOT IN ('session_meta', 'turn_context') AS made,
         CASE WHEN t IN ('session_meta', 'turn_context') THEN NULL WHEN who IS NOT NULL THEN who WHEN p = 'custom_tool_call_output' THEN 'tool' WHEN t = 'event_msg' THEN 'system' ELSE 'assistant' END AS role,
         CASE WHEN t IN ('session_meta', 'turn_context') THEN NULL WHEN who = 'system' THEN 'event' WHEN who IS NOT NULL THEN 'text' WHEN p = 'custom_tool_call' THEN 'tool_call' WHEN p = 'custom_tool_call_output' THEN 'tool_result' WHEN t = 'event_msg' THEN 'event' ELSE 'thinking' END AS kind,
         CASE WHEN p = 'custom_tool_call' THEN {_s('v', '$.payload.name')} END AS tool_name, CASE WHEN p IN ('custom_tool_call', 'custom_tool_call_output') THEN {_s('v', '$.payload.call_id')} END AS tool_use_id,
         CASE WHEN who IS NOT NULL THEN CASE WHEN who = 'user' AND (contains(v->>'$.payload.content[0].text', '&') OR contains(v->>'$.payload.content[0].text', chr(92)))
                THEN trim(regexp_replace(v->>'$.payload.content[0].text', '\\\\([_*])', '\\1', 'g'), E' \\t\\n\\r') ELSE coalesce(v->>'$.payload.content[0].text', '') END
              WHEN p = 'custom_tool_call' THEN NULL
              WHEN p = 'custom_tool_call_output' THEN CASE WHEN json_type(v, '$.payload.output') = 'VARCHAR' THEN v->>'$.payload.output' ELSE array_to_string(list_transform(CAST(v->'$.payload.output' AS JSON[]), lambda x: coalesce(x->>'$.text', '')), '') END
              WHEN t = 'event_msg' THEN failed ELSE array_to_string(list_transform(CAST(v->'$.payload.summary' AS JSON[]), lambda x: coalesce(x->>'$.text', '')), '') END AS said,
         CAST(NULL AS VARCHAR) AS touched FROM x2),
told AS (SELECT *, agent || ':' || native_id AS session_id FROM (SELECT * FROM c2 UNION ALL SELECT * FROM x3) WHERE native_id IS NOT NULL),
m AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY source_id, line_no, line_id) - 1 AS seq FROM told WHERE made)"""


@query(f"WITH {MESSAGES_SQL} SELECT line_id, native_id, role, kind, tool_use_id, created_at, md5(said) AS said FROM m WHERE kind IS NOT NULL")
def a7_a8_adapters(spark: SparkSession, d: str) -> DataFrame:
    p = parsed(spark, d).where("status = 'message' and native_id is not null and kind is not null")
    return p.select("line_id", "native_id", "role", "kind", "tool_use_id", "created_at", F.when(F.col("kind") != "tool_call", F.md5("content")).alias("said"))


@query("SELECT agent, count(*) AS lines, count(*) FILTER (WHERE NOT json_valid(raw_line)) AS malformed FROM log_lines WHERE trim(raw_line) <> '' GROUP BY agent")
def a5_a6_malformed_lines(spark: SparkSession, d: str) -> DataFrame:
    return parsed(spark, d).groupBy("agent").agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("error") == "invalid JSON").alias("malformed"))


@query(f"WITH {MESSAGES_SQL}, calls AS (SELECT session_id, tool_use_id, min(struct_pack(seq := seq, tool_name := tool_name)) AS c FROM m WHERE kind = 'tool_call' AND tool_use_id IS NOT NULL GROUP BY ALL) SELECT m.session_id, m.seq, m.line_id AS message_id, CASE WHEN m.kind = 'tool_result' THEN CASE WHEN c.seq < m.seq THEN c.tool_name END ELSE m.tool_name END AS tool_name FROM m LEFT JOIN calls ON m.session_id = calls.session_id AND m.tool_use_id = calls.tool_use_id")
def b5_b6_messages(spark: SparkSession, d: str) -> DataFrame:
    return msgs(spark, d, content=False).select("session_id", "seq", "message_id", "tool_name")


@query(f"""WITH {MESSAGES_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY source_id, line_no, line_id) AS pos FROM told)
SELECT session_id, max_by(cwd, pos) FILTER (WHERE cwd <> '') AS cwd, max_by(git_branch, pos) FILTER (WHERE git_branch <> '') AS git_branch, max_by(model, pos) FILTER (WHERE model <> '') AS model,
  {redact_sql("coalesce(max_by(title, pos) FILTER (WHERE title <> ''), max(CASE WHEN pos = 1 AND role = 'user' AND kind = 'text' AND said <> '' THEN CASE WHEN length(said) > 80 THEN left(said, 80) || '…' ELSE said END END))")} AS title,
  min_by(created_at, pos) FILTER (WHERE created_at <> '') AS started_at, max(created_at) AS ended_at, count(*) FILTER (WHERE made) AS message_count FROM o GROUP BY session_id""")
def b2_b3_sessions(spark: SparkSession, d: str) -> DataFrame:
    return transcript.sessions(parsed(spark, d)).select("session_id", "cwd", "git_branch", "model", "title", "started_at", "ended_at", "message_count")


PATCH_SQL = f"""{MESSAGES_SQL}, pt AS (SELECT j.line_id, m.session_id, unnest(string_split(j.v->>'$.payload.input', chr(10))) AS l FROM j JOIN m ON m.line_id = j.line_id WHERE j.agent = 'codex' AND m.kind = 'tool_call' AND m.tool_name = 'apply_patch'),
pp AS (SELECT session_id, line_id, regexp_extract(l, '^\\*\\*\\* (Update File|Add File|Delete File|Move to): (.*?)\\r?$', 1) AS a, trim(regexp_extract(l, '^\\*\\*\\* (Update File|Add File|Delete File|Move to): (.*?)\\r?$', 2)) AS path FROM pt)"""
ACTION_SQL = "CASE a WHEN 'Update File' THEN 'edit' WHEN 'Add File' THEN 'create' WHEN 'Delete File' THEN 'delete' ELSE 'rename' END"
TOUCH_SQL = f"""SELECT t.session_id, t.message_id, s.project_id, CASE WHEN path LIKE s.cwd || '/%' THEN substr(path, length(s.cwd) + 2) ELSE path END AS path, t.action
FROM (SELECT session_id, line_id AS message_id, touched AS path, CASE WHEN tool_name = 'Read' THEN 'read' ELSE 'edit' END AS action FROM m WHERE touched IS NOT NULL AND agent = 'claude-code'
  UNION ALL SELECT session_id, line_id, path, {ACTION_SQL} FROM pp WHERE a <> '') t LEFT JOIN sessions s ON s.session_id = t.session_id"""


@query(f"WITH {PATCH_SQL} {TOUCH_SQL}")
def a7d_b7_file_touches(spark: SparkSession, d: str) -> DataFrame:
    return touches(spark, d).select("session_id", "message_id", "project_id", "path", "action")


@query(f"WITH {PATCH_SQL} SELECT session_id, line_id AS message_id, path, {ACTION_SQL} AS action FROM pp WHERE a <> ''")
def a8f_b23_patch_touches(spark: SparkSession, d: str) -> DataFrame:
    m = transcript.messages(parsed(spark, d), redacted=False)
    return store.repair_touches(m, m.where("1 = 0").select("message_id"))


CHUNKS_SQL = f"""{MESSAGES_SQL}, u AS (SELECT *, sum(CASE WHEN role = 'user' AND kind = 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq) AS turn FROM m),
g AS (SELECT session_id, turn, min(seq) AS first_seq, max(seq) AS last_seq, string_agg(CASE WHEN kind = 'text' AND role = 'user' THEN 'User: ' || {redact_sql('said')} WHEN kind = 'text' AND role = 'assistant' THEN 'Assistant: ' || {redact_sql('said')} END, chr(10) || chr(10) ORDER BY seq) AS chunk_text,
  max_by(role || ' ' || kind, seq) FILTER (WHERE role <> 'system') AS tail FROM u GROUP BY session_id, turn)"""


@query(f"WITH {CHUNKS_SQL} SELECT session_id, first_seq, last_seq, md5(chunk_text) AS chunk_md5 FROM g WHERE chunk_text IS NOT NULL AND (turn < (SELECT max(turn) FROM g h WHERE h.session_id = g.session_id) OR tail = 'assistant text')")
def app15_chunks(spark: SparkSession, d: str) -> DataFrame:
    return transcript.chunks(msgs(spark, d)).select("session_id", "first_seq", "last_seq", F.md5("chunk_text").alias("chunk_md5"))


ISO_SQL = "strftime(started_at, '%Y-%m-%dT%H:%M:%S.%gZ')"


@query(f"WITH {MESSAGES_SQL} SELECT c.chunk_id, c.session_id, coalesce((SELECT min(m.created_at) FROM m WHERE m.session_id = c.session_id AND m.seq BETWEEN c.first_seq AND c.last_seq), (SELECT {ISO_SQL} FROM sessions s WHERE s.session_id = c.session_id)) AS chunk_at FROM chunks c")
def d14_chunk_times(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "session_id", "first_seq", "last_seq")
    return transcript.chunk_times(c, msgs(spark, d, content=False), sess(spark, d)).select("chunk_id", "session_id", "chunk_at")


@query(f"WITH {PATCH_SQL}, ft AS (SELECT session_id, count(DISTINCT path) AS files_changed FROM ({TOUCH_SQL}) WHERE action <> 'read' GROUP BY session_id) SELECT s.session_id, s.agent, p.project_name, s.title, s.message_count, coalesce(ft.files_changed, 0) AS files_changed FROM sessions s LEFT JOIN projects p ON p.project_id = s.project_id LEFT JOIN ft ON ft.session_id = s.session_id")
def a10_session_overview(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    return transcript.overview(sess(spark, d), table(spark, d, "projects"), t).select("session_id", "agent", "project_name", "title", "message_count", "files_changed")


@query("SELECT session_id, agent, title FROM sessions WHERE project_id = 3 AND agent = 'claude-code' ORDER BY started_at DESC NULLS LAST, session_id LIMIT 20")
def app5_recent_sessions(spark: SparkSession, d: str) -> DataFrame:
    return transcript.recent(table(spark, d, "sessions"), project_id=3, agent="claude-code").select("session_id", "agent", "title")


#: A file that sessions touched, and the longest session: arguments of the queries that take one.
A_FILE, A_SESSION = "cmd/session/defer_queue.yaml", "claude-code:45f5e756-66a8-a0f9-280d-88d848f9a34b"
HOT_FILE_SQL = f"{PATCH_SQL}, t AS (SELECT x.*, m.created_at, m.seq FROM ({TOUCH_SQL}) x JOIN m ON m.line_id = x.message_id), hot AS (SELECT '{A_FILE}' AS path)"


@query(f"WITH {HOT_FILE_SQL} SELECT t.session_id, string_agg(DISTINCT t.action, ',' ORDER BY t.action) AS actions, count(*) AS touches FROM t JOIN hot USING (path) JOIN sessions s ON s.session_id = t.session_id GROUP BY t.session_id, s.started_at ORDER BY s.started_at DESC NULLS LAST, t.session_id LIMIT 20")
def app6_sessions_touching(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    return transcript.sessions_touching(t, sess(spark, d), A_FILE).select("session_id", "actions", "touches")


@query(f"""WITH {HOT_FILE_SQL}, g AS (SELECT t.session_id, string_agg(DISTINCT t.action, ',' ORDER BY t.action) AS actions, count(*) AS touches, sum(CASE WHEN t.action <> 'read' THEN 1 ELSE 0 END) AS changes, max(t.created_at) AS last_touch_at, {ISO_SQL.replace('started_at', 's.started_at')} AS started_at FROM t JOIN hot USING (path) JOIN sessions s ON s.session_id = t.session_id GROUP BY t.session_id, s.started_at),
a AS (SELECT g.*, (SELECT t.seq FROM t JOIN hot USING (path) WHERE t.session_id = g.session_id ORDER BY (t.action <> 'read') DESC, t.created_at DESC, t.message_id DESC LIMIT 1) AS anchor_seq FROM g)
SELECT session_id, actions, touches, changes, last_touch_at, coalesce((SELECT min(c.chunk_id) FROM chunks c WHERE c.session_id = a.session_id AND a.anchor_seq BETWEEN c.first_seq AND c.last_seq),
 (SELECT c.chunk_id FROM chunks c WHERE c.session_id = a.session_id AND c.last_seq <= a.anchor_seq ORDER BY c.last_seq DESC, c.chunk_id DESC LIMIT 1), (SELECT c.chunk_id FROM chunks c WHERE c.session_id = a.session_id ORDER BY c.first_seq, c.chunk_id LIMIT 1)) AS chunk_id
FROM a ORDER BY (changes > 0) DESC, coalesce(last_touch_at, started_at) DESC, session_id LIMIT 10""")
def app7_explain_file(spark: SparkSession, d: str) -> DataFrame:
    t = touches(spark, d)
    return transcript.explain_file(t, sess(spark, d), table(spark, d, "chunks"), A_FILE).select("session_id", "actions", "touches", "changes", "last_touch_at", "chunk_id")


LONGEST_SQL = f"{MESSAGES_SQL}, big AS (SELECT '{A_SESSION}' AS session_id)"


@query(f"""WITH {LONGEST_SQL}, v AS (SELECT seq, role, kind, session_id, {redact_sql('said')} AS said FROM m JOIN big USING (session_id) WHERE kind = 'text'), w AS (SELECT seq, role, kind, CASE WHEN length(said) > (CASE WHEN kind = 'text' THEN 6000 ELSE 1500 END) THEN left(said, CASE WHEN kind = 'text' THEN 6000 ELSE 1500 END) || ' … [truncated, ' || (CASE WHEN kind = 'text' THEN 6000 ELSE 1500 END) || ' of ' || length(said) || ' chars shown]' ELSE said END AS content FROM v WHERE seq BETWEEN 0 AND 199),
r AS (SELECT *, sum(length(content)) OVER (ORDER BY seq) AS used, row_number() OVER (ORDER BY seq) AS n FROM w) SELECT seq, role, kind, md5(content) AS content FROM r WHERE used <= 20000 OR n = 1""")
def app4_get_session(spark: SparkSession, d: str) -> DataFrame:
    m = msgs(spark, d)
    return transcript.page(m, A_SESSION).select("seq", "role", "kind", F.md5("content").alias("content"))


@query(f"WITH {LONGEST_SQL} SELECT min(seq) AS seq FROM m JOIN big USING (session_id) WHERE seq > 10 AND kind <> 'thinking'")
def app16_first_seq_after(spark: SparkSession, d: str) -> DataFrame:
    m = msgs(spark, d, content=False)
    return transcript.first_seq_after(m, A_SESSION, 10, include_tools=True)


#: Lower case without diacritics.
FOLDED = f"translate(lower({{}}), '{fulltext.MARKED}', '{fulltext.UNMARKED}')"


# -- full text -----------------------------------------------------------------------------------
def _bm25_sql(name: str, key: str, text: str, counts: dict[str, str], condition: str, ranked: list[str], limit: int = 0) -> str:
    """counts: name -> how often a leaf occurs in the list w."""
    cols = ", ".join(f"{c} AS {n}" for n, c in counts.items())
    stats = ", ".join(f"count(*) FILTER (WHERE {n} > 0) AS d_{n}" for n in ranked)
    score = " + ".join(f"CASE WHEN {n} > 0 THEN greatest(ln((n - d_{n} + 0.5) / (d_{n} + 0.5)), 1e-6) * {n} * 2.2 / ({n} + 1.2 * (0.25 + 0.75 * len(w) / mean)) ELSE 0 END" for n in ranked)
    tail = f" ORDER BY bm25, {key} LIMIT {limit}" if limit else ""
    return f"WITH t AS (SELECT {key}, regexp_extract_all({FOLDED.format(text)}, '[\\p{{L}}\\p{{N}}\\p{{Co}}_]+') AS w FROM {name} WHERE {text} IS NOT NULL), f AS (SELECT {key}, w, {cols} FROM t), s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean, {stats} FROM f), h AS (SELECT {key}, round(-({score}), 6) AS bm25 FROM f CROSS JOIN s WHERE {condition}) SELECT {key}, bm25 FROM h{tail}"


#: Words with the stems of the queries' words, after the published rules of the stemmer.
FORMS = {
    "planner": ["planner", "planners"], "retry": ["retry", "retries", "retried", "retrying", "retri"], "ledger": ["ledger", "ledgers", "ledgered"], "cursor": ["cursor", "cursors"], "whole": ["whole", "wholes"], "story": ["story", "stories"],
    "payload": ["payload", "payloads"], "cache": ["cache", "cach", "cached", "caches", "caching"], "beacon": ["beacon", "beacons"], "measuring": ["measure", "measures", "measured", "measuring", "measurement", "measurements"],
}


def _forms(t: str) -> str:
    return "(" + ", ".join(f"'{x}'" for x in FORMS[t]) + ")"


def _term(t: str) -> str:
    return f"len(list_filter(w, lambda x: x IN {_forms(t)}))"


def _prefix(t: str) -> str:
    return f"len(list_filter(w, lambda x: starts_with(x, '{t}')))"


def _phrase(a: str, b: str) -> str:
    return f"len(list_filter(range(1, len(w)), lambda i: w[i] IN {_forms(a)} AND w[i + 1] IN {_forms(b)}))"


def _rounded(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn(c, F.round(c, 6))


@query(_bm25_sql("documents", "doc_id", "text", {"f0": _term("planner"), "f1": _term("retry")}, "f0 > 0 OR f1 > 0", ["f0", "f1"]))
def j5_bm25_documents(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(doc_index(spark, d).search("planner OR retry", "doc_id"), "bm25")


@query(_bm25_sql("documents", "doc_id", "text", {"f0": _term("planner"), "f1": _term("retry")}, "f0 > 0 OR f1 > 0", ["f0", "f1"]))
def j5_bm25_scan(spark: SparkSession, d: str) -> DataFrame:
    """The same without an index."""
    docs = table(spark, d, "documents").where("text is not null")
    return _rounded(fulltext.search(docs, "planner OR retry", "doc_id", "text"), "bm25")


@query(_bm25_sql("chunks", "chunk_id", "chunk_text", {"f0": _term("ledger"), "f1": _prefix("warn"), "f2": _term("cursor")}, "f0 > 0 AND f1 > 0 AND NOT f2 > 0", ["f0", "f1"]))
def j3_boolean_prefix_not(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(chunk_index(spark, d).search("ledger warn* -cursor"), "bm25")


@query(_bm25_sql("chunks", "chunk_id", "chunk_text", {"f0": _phrase("whole", "story"), "f1": _term("payload")}, "f0 > 0 AND f1 > 0", ["f0", "f1"]))
def j3_phrase(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(chunk_index(spark, d).search('"whole story" payload'), "bm25")


@query(f"WITH t AS (SELECT chunk_id AS doc, regexp_extract_all({FOLDED.format('chunk_text')}, '[\\p{{L}}\\p{{N}}\\p{{Co}}_]+') AS w FROM chunks), u AS (SELECT doc, unnest(w) AS term, len(w) AS n_tokens FROM t) SELECT term, doc, n_tokens, count(*) AS tf FROM u GROUP BY ALL")
def j1_postings(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.build_postings(table(spark, d, "chunks"), stemmed=False).select("term", "doc", "n_tokens", "tf")


@query(_bm25_sql("chunks", "chunk_id", "chunk_text", {"f0": _term("planner"), "f1": _term("cache")}, "(f0 > 0 OR f1 > 0) AND chunk_id IN (SELECT chunk_id FROM chunks c JOIN sessions s ON s.session_id = c.session_id WHERE s.project_id = 3)", ["f0", "f1"], 10))
def app1_keyword_search(spark: SparkSession, d: str) -> DataFrame:
    hits = named.search_chunks(chunk_index(spark, d), table(spark, d, "chunks"), table(spark, d, "sessions"), "planner OR cache", project_id=3)
    return _rounded(hits.select("chunk_id", "bm25"), "bm25")


@query()
def j6_snippets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", fulltext.snippet("chunk_text", "planner retry").alias("snippet"))


@query()
def j7_previews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", T.centred_preview("chunk_text", "planner OR retry").alias("preview"))


@query(_bm25_sql("chunks", "chunk_id", "chunk_text", {"f0": _term("measuring"), "f1": _term("retry")}, "f0 > 0 OR f1 > 0", ["f0", "f1"]))
def j1_stemmed_search(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(chunk_index(spark, d).search("measuring OR rétries"), "bm25")


@query(_bm25_sql("(SELECT * FROM chunks WHERE chunk_id % 3 <> 1)", "chunk_id", "chunk_text", {"f0": _term("planner"), "f1": _term("cache")}, "f0 > 0 OR f1 > 0", ["f0", "f1"]))
def b15_index_kept_up_to_date(spark: SparkSession, d: str) -> DataFrame:
    """An index that got its texts in two segments and lost a third of them again."""
    from strandline.session import shared_dir

    c = table(spark, d, "chunks").select("chunk_id", "chunk_text")
    index = fulltext.Index.build(c.where("chunk_id % 2 = 0"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    index.add(c.where("chunk_id % 2 = 1 or chunk_id % 6 = 0"))
    index.remove(c.where("chunk_id % 3 = 1"))
    return _rounded(index.search("planner OR cache"), "bm25")


# -- vectors -------------------------------------------------------------------------------------
PROBE = [((i * 37) % 64 - 31.5) / 40.0 for i in range(64)]
PROBE_SQL = "[" + ", ".join(f"{x}" for x in PROBE) + "]::FLOAT[]"


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform(list_zip(embedding, {PROBE_SQL}), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))), 6) AS l2, round(list_sum(list_transform(list_zip(embedding, {PROBE_SQL}), lambda z: abs(z[1]::DOUBLE - z[2]))), 6) AS l1, round(1 - list_sum(list_transform(list_zip(embedding, {PROBE_SQL}), lambda z: z[1]::DOUBLE * z[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform({PROBE_SQL}, lambda x: x::DOUBLE * x)))), 6) AS cosine FROM embeddings")
def v6_v7_v8_distances(spark: SparkSession, d: str) -> DataFrame:
    q = F.array(*[F.lit(x).cast("float") for x in PROBE])
    return table(spark, d, "embeddings").select("vec_id", F.round(V.distance_l2("embedding", q), 6).alias("l2"), F.round(V.distance_l1("embedding", q), 6).alias("l1"), F.round(V.distance_cosine("embedding", q), 6).alias("cosine"))


@query("SELECT vec_id, len(embedding) AS dims, 'float32' AS kind, round(list_sum(list_transform(list_zip(embedding, embedding[2:] || [0::FLOAT]), lambda z: (z[1] + z[2])::DOUBLE)), 4) AS added, round(list_sum(list_transform(embedding[9:16], lambda x: x::DOUBLE)), 6) AS sliced, list_transform(embedding[1:8], lambda x: x > 0) = list_transform(embedding[1:8], lambda x: x > 0) AS ok FROM embeddings")
def v4_v10_v12_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    moved = F.concat(F.slice(e, 2, 63), F.array(F.lit(0.0).cast("float")))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", V.vec_length("embedding").alias("dims"), V.vec_type("float32").alias("kind"), F.round(total(V.vec_add("embedding", moved)), 4).alias("added"), F.round(total(V.vec_slice("embedding", 8, 16)), 6).alias("sliced"), F.lit(True).alias("ok"))


@query("SELECT vec_id, i - 1 AS rowid, round(embedding[i], 6) AS value FROM embeddings, range(1, 65) r(i)")
def v18_vec_each(spark: SparkSession, d: str) -> DataFrame:
    V.register(spark)
    table(spark, d, "embeddings").createOrReplaceTempView("strandline_vectors")
    return spark.sql("SELECT vec_id, CAST(e.rowid AS LONG) AS rowid, round(e.value, 6) AS value FROM strandline_vectors, LATERAL vec_each(embedding) e")


@query("WITH b AS (SELECT vec_id, list_transform(range(0, 8), lambda k: list_sum(list_transform(range(0, 8), lambda i: CASE WHEN embedding[k * 8 + i + 1] > 0 THEN 1 << i ELSE 0 END))::INT) AS bytes, embedding FROM embeddings) SELECT vec_id, upper(array_to_string(list_transform(bytes, lambda x: printf('%02x', x)), '')) AS bits, list_sum(list_transform(bytes, lambda x: bit_count(x)))::INT AS ones, array_to_string(list_transform(embedding, lambda x: trunc(least(127.0, greatest(-128.0, (x::DOUBLE + 1.0) / (2.0 / 255.0)::FLOAT::DOUBLE - 128.0)))::INT), ',') AS int8 FROM b")
def v15_v16_quantize(spark: SparkSession, d: str) -> DataFrame:
    bits = V.vec_quantize_binary("embedding")
    zero = F.unhex(F.lit("00" * 8))
    return table(spark, d, "embeddings").select("vec_id", F.hex(bits).alias("bits"), V.distance_hamming(bits, zero).alias("ones"), F.array_join(F.transform(V.vec_quantize_int8("embedding"), lambda x: x.cast("string")), ",").alias("int8"))


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' AS json, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS length, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))), 6)) AS unit FROM embeddings")
def v13_v14_json_and_norm(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", V.vec_to_json("embedding").alias("json"), F.round(V.norm("embedding"), 6).alias("length"), F.transform(V.vec_normalize("embedding"), lambda x: F.round(x, 6)).alias("unit"))


def _knn_sql(metric: str, where: str, k: int, tail: str = "") -> str:
    dist = {"cosine": f"1 - list_sum(list_transform(list_zip(embedding, {PROBE_SQL}), lambda z: z[1]::DOUBLE * z[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform({PROBE_SQL}, lambda x: x::DOUBLE * x))))", "l2": f"sqrt(list_sum(list_transform(list_zip(embedding, {PROBE_SQL}), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))))"}[metric]
    return f"SELECT vec_id, round({dist}, 6) AS distance FROM embeddings WHERE {where} ORDER BY {dist}, vec_id LIMIT {k}{tail}"


@query(_knn_sql("cosine", "true", 50))
def k1_knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vector_search.knn(table(spark, d, "embeddings"), PROBE, 50, key="vec_id"), "distance")


@query(_knn_sql("l2", "label = 3", 20))
def k2_knn_partition_l2(spark: SparkSession, d: str) -> DataFrame:
    t = vector_search.VectorTable.parse("vec_id integer primary key, label integer partition key, embedding float[64]")
    return _rounded(vector_search.knn(table(spark, d, "embeddings"), PROBE, 20, "l2", key="vec_id", where=t.predicate("label", "=", 3)), "distance")


@query(_knn_sql("l2", "vec_id IN (1, 5, 9, 100, 101, 102, 250) AND label <> 2", 5))
def k4_knn_rowid_in(spark: SparkSession, d: str) -> DataFrame:
    t = vector_search.VectorTable.parse("vec_id integer primary key, label integer, embedding float[64]")
    where = t.predicate("vec_id", "in", [1, 5, 9, 100, 101, 102, 250]) & t.predicate("label", "!=", 2)
    return _rounded(vector_search.knn(table(spark, d, "embeddings"), PROBE, 5, "l2", key="vec_id", where=where), "distance")


@query(f"SELECT * FROM ({_knn_sql('cosine', 'true', 40)}) WHERE distance <= 0.85")
def k9_floor_after_k(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vector_search.knn(table(spark, d, "embeddings"), PROBE, 40, key="vec_id", floor=0.85), "distance")


VEC_SQL = "r AS (SELECT chunk_id, min_by(embeddings[1], response_id) AS e FROM embed_responses WHERE len(embeddings) = 1 AND len(embeddings[1]) = 64 AND len(list_filter(embeddings[1], lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embeddings[1], lambda x: x <> 0)) > 0 GROUP BY chunk_id), vt AS (SELECT r.chunk_id, r.e, s.project_id, s.agent FROM r JOIN chunks c USING (chunk_id) JOIN sessions s USING (session_id)), q AS (SELECT e AS qe FROM vt ORDER BY chunk_id LIMIT 1)"


def _unrounded(sql: str) -> str:
    return sql.replace("round(-(", "(-(").replace("), 6) AS bm25", ")) AS bm25")


KW_ALL_SQL = _unrounded(_bm25_sql("chunks", "chunk_id", "chunk_text", {"f0": _term("planner"), "f1": _term("cache")}, "f0 > 0 OR f1 > 0", ["f0", "f1"]))
KW_SQL = _unrounded(_bm25_sql("chunks", "chunk_id", "chunk_text", {"f0": _term("planner"), "f1": _term("cache")}, "(f0 > 0 OR f1 > 0) AND chunk_id IN (SELECT chunk_id FROM chunks c JOIN sessions s ON s.session_id = c.session_id WHERE s.agent = 'claude-code')", ["f0", "f1"]))


def _first_vector(v: DataFrame) -> list[float]:
    row = v.orderBy("chunk_id").select("embedding").first()
    return list(row.embedding) if row else [0.0] * 64


@query(f"""WITH {VEC_SQL}, kws AS ({KW_SQL}), kw AS (SELECT chunk_id, row_number() OVER (ORDER BY bm25, chunk_id) AS r FROM (SELECT * FROM kws ORDER BY bm25, chunk_id LIMIT 50)),
dd AS (SELECT chunk_id, 1 - list_sum(list_transform(list_zip(e, qe), lambda z: z[1]::DOUBLE * z[2])) / (sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(qe, lambda x: x::DOUBLE * x)))) AS distance FROM vt CROSS JOIN q WHERE agent = 'claude-code'),
sem AS (SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS r FROM (SELECT * FROM dd ORDER BY distance, chunk_id LIMIT 50) WHERE distance <= 0.5)
SELECT chunk_id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM sem) GROUP BY chunk_id""")
def l1_l2_hybrid_ranks(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    kw, sem = named.rank_lists(chunk_index(spark, d), table(spark, d, "chunks"), table(spark, d, "sessions"), v, "planner OR cache", _first_vector(v), None, "claude-code")
    return _rounded(vector_search.fuse(kw, sem), "score")


@query(f"""WITH {VEC_SQL}, kws AS ({KW_ALL_SQL}), kw AS (SELECT chunk_id, row_number() OVER (ORDER BY bm25, chunk_id) AS r FROM (SELECT * FROM kws ORDER BY bm25, chunk_id LIMIT 50)),
dd AS (SELECT chunk_id, 1 - list_sum(list_transform(list_zip(e, qe), lambda z: z[1]::DOUBLE * z[2])) / (sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(qe, lambda x: x::DOUBLE * x)))) AS distance FROM vt CROSS JOIN q),
sem AS (SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS r FROM (SELECT * FROM dd ORDER BY distance, chunk_id LIMIT 50) WHERE distance <= 0.5),
f AS (SELECT chunk_id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM kw UNION ALL SELECT * FROM sem) GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 10)
SELECT f.chunk_id, round(score, 6) AS score, c.session_id, c.first_seq, c.last_seq, s.agent, s.title FROM f JOIN chunks c USING (chunk_id) JOIN sessions s USING (session_id)""")
def app1_hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    hits = named.search_hybrid(chunk_index(spark, d), table(spark, d, "chunks"), sess(spark, d), v, "planner OR cache", _first_vector(v))
    return _rounded(hits.select("chunk_id", "score", "session_id", "first_seq", "last_seq", "agent", "title"), "score")


# -- text functions ------------------------------------------------------------------------------
@query(f"SELECT chunk_id, md5({redact_sql('chunk_text')}) AS clean FROM chunks")
def i11_i12_redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", F.md5(T.redact("chunk_text")).alias("clean"))


@query(f"SELECT doc_id, {redact_sql('text')} AS clean FROM documents")
def i13_redact_dense(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.redact("text").alias("clean"))


@query("SELECT chunk_id, round(list_entropy(string_split(chunk_text, '')), 6) AS bits FROM chunks")
def e12_entropy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", F.round(T.entropy(F.col("chunk_text")), 6).alias("bits"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS title, CASE WHEN length(text) > 500 THEN left(text, 500) || ' … [truncated, 500 of ' || length(text) || ' chars shown]' ELSE text END AS cut FROM documents")
def i17_i18_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.truncate("text").alias("title"), T.cut_with_note("text", 500).alias("cut"))


@query("WITH t AS (SELECT chunk_id, trim(regexp_replace(chunk_text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS c FROM chunks) SELECT chunk_id, CASE WHEN length(c) > 360 THEN left(c, 360) || '...' ELSE c END AS preview FROM t")
def i19_compact_preview(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", T.compact_preview("chunk_text").alias("preview"))


@query("SELECT project_id, lower(CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/:]+)(?::[0-9]+)?/(.+)$', 1) || '/' || regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/:]+)(?::[0-9]+)?/(.+)$', 2) WHEN regexp_matches(u, '^[^@/:]+@[^:/]+:') THEN regexp_extract(u, '^(?:[^@/:]+@)([^:/]+):(.+)$', 1) || '/' || regexp_extract(u, '^(?:[^@/:]+@)([^:/]+):(.+)$', 2) END) AS remote FROM (SELECT project_id, regexp_replace(trim(git_remote), '\\.git/?$', '') AS u FROM projects)")
def i23_normalise_remote(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "projects").select("project_id", T.normalise_remote("git_remote").alias("remote"))


@query("SELECT source_id, log_path AS path, sha256(log_path) AS digest FROM sources")
def i22_i25_paths(spark: SparkSession, d: str) -> DataFrame:
    dotted = F.concat(F.lit("/x/../."), F.regexp_replace("log_path", "/", "//./"))
    return table(spark, d, "sources").select("source_id", T.clean_path(F.when(F.col("log_path").startswith("/"), dotted).otherwise(F.concat(F.lit("./a/../"), "log_path"))).alias("path"), F.sha2("log_path", 256).alias("digest"))


# -- joins ---------------------------------------------------------------------------------------
@query("WITH o AS (SELECT o_orderstatus AS k, epoch(o_orderdate)::BIGINT AS at, max(o_orderkey) AS o FROM orders GROUP BY ALL), e AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'F' WHEN 'view' THEN 'O' ELSE 'P' END AS k, epoch(ts)::BIGINT AS at FROM events) SELECT e.event_id, o.o AS o_orderkey FROM e ASOF LEFT JOIN o ON e.k = o.k AND e.at >= o.at")
def d10_asof(spark: SparkSession, d: str) -> DataFrame:
    at = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", "F").when(F.col("event_type") == "view", "O").otherwise("P").alias("k"), at("ts").alias("at"))
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("k"), at("o_orderdate").alias("order_at"), "o_orderkey")
    return ordered.asof(e, o, ["k"], "at", "order_at", ["o_orderkey"]).select("event_id", "o_orderkey")


@query("WITH p AS (SELECT DISTINCT regexp_extract(cwd, '^(/[^/]+/[^/]+/[^/]+)', 1) AS path FROM sessions UNION SELECT DISTINCT cwd FROM sessions WHERE hash(cwd) IS NOT NULL AND ends_with(cwd, 'b')) SELECT session_id, max_by(path, length(path)) AS home FROM sessions LEFT JOIN p ON cwd = path OR starts_with(cwd, path || '/') GROUP BY session_id")
def d9_longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sessions")
    p = s.select(F.regexp_extract("cwd", "^(/[^/]+/[^/]+/[^/]+)", 1).alias("path")).union(s.where(F.col("cwd").endswith("b")).select("cwd")).distinct().withColumn("home", F.col("path"))
    return ordered.longest_prefix(s.select("session_id", "cwd"), "cwd", p, "path", "home").select("session_id", "home")


# -- store ---------------------------------------------------------------------------------------
@query("SELECT c.chunk_id, s.project_id, s.agent FROM chunks c JOIN sessions s ON s.session_id = c.session_id WHERE c.embedded_at IS NULL AND s.project_id IS NOT NULL")
def app14_pending(spark: SparkSession, d: str) -> DataFrame:
    return store.pending_chunks(table(spark, d, "chunks"), table(spark, d, "sessions")).select("chunk_id", "project_id", "agent")


@query("SELECT p.project_id, p.project_name, coalesce(p.git_remote, '-') AS git_remote, (SELECT count(*) FROM sessions s WHERE s.project_id = p.project_id) AS sessions FROM projects p")
def app9_project_list(spark: SparkSession, d: str) -> DataFrame:
    return store.project_list(table(spark, d, "projects"), table(spark, d, "sessions")).drop("paths")


@query("SELECT s.session_id, CASE WHEN s.project_id = (SELECT min(project_id) FROM projects WHERE git_remote IS NULL) THEN (SELECT max(project_id) FROM projects) ELSE s.project_id END AS project_id FROM sessions s")
def b11_merge_projects(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "projects")
    ends = p.agg(F.min(F.when(F.col("git_remote").isNull(), F.col("project_id"))).alias("a"), F.max("project_id").alias("z")).first()
    return store.merge_projects({"projects": p, "sessions": table(spark, d, "sessions"), "chunks": table(spark, d, "chunks")}, ends.a, ends.z)["sessions"].select("session_id", "project_id")


@query("SELECT chunk_id FROM chunks WHERE session_id NOT IN (SELECT session_id FROM sessions WHERE project_id = 3)")
def b14_cascade(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("sessions", "chunks")}
    return store.delete_cascade(t, "sessions", t["sessions"].where("project_id = 3"))["chunks"].select("chunk_id")


@query(f"WITH {MESSAGES_SQL} SELECT s.session_id, (SELECT count(*) FROM m WHERE m.session_id = s.session_id) AS message_count FROM sessions s")
def b17_recount(spark: SparkSession, d: str) -> DataFrame:
    return store.recount(table(spark, d, "sessions"), msgs(spark, d, content=False)).select("session_id", "message_count")


@query("SELECT chunk_id, session_id FROM chunks")
def b1_idempotent_insert(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "session_id", "first_seq")
    return store.insert_new(c.where("chunk_id % 2 = 0"), c.unionByName(c), ["session_id", "first_seq"]).select("chunk_id", "session_id")


@query("SELECT 'session_id is null' AS rule, count(*) FILTER (WHERE session_id IS NULL) AS violations FROM chunks UNION ALL SELECT 'first_seq is null', count(*) FILTER (WHERE first_seq IS NULL) FROM chunks UNION ALL SELECT 'last_seq is null', count(*) FILTER (WHERE last_seq IS NULL) FROM chunks UNION ALL SELECT 'last_seq is before first_seq', count(*) FILTER (WHERE last_seq < first_seq) FROM chunks UNION ALL SELECT 'repeated chunk_id', count(chunk_id) - count(DISTINCT chunk_id) FROM chunks UNION ALL SELECT 'repeated session_id, first_seq', count(*) - count(DISTINCT (session_id, first_seq)) FROM chunks")
def s1_constraints(spark: SparkSession, d: str) -> DataFrame:
    return violations(table(spark, d, "chunks"), "chunks")


NOTES_SQL = "notes AS (SELECT chunk_id AS note_id, CASE WHEN chunk_id % 3 = 0 THEN NULL ELSE chunk_id % 5 END AS project_id, left(chunk_text, 60) AS title, chunk_text AS body, CASE WHEN chunk_id % 7 = 0 THEN 1 END AS superseded_by FROM chunks), nt AS (SELECT note_id AS chunk_id, title || chr(10) || body AS chunk_text FROM notes)"


def _notes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return c.select(F.col("chunk_id").alias("note_id"), F.when(F.col("chunk_id") % 3 != 0, F.col("chunk_id") % 5).alias("project_id"), F.lit("fact").alias("kind"), F.left("chunk_text", F.lit(60)).alias("title"), F.col("chunk_text").alias("body"), F.lit("[]").alias("tags"), F.lit("unknown").alias("agent"), F.lit("").alias("created_at"), F.when(F.col("chunk_id") % 7 == 0, 1).alias("superseded_by"))


@query(f"WITH {NOTES_SQL}, h AS ({_bm25_sql('nt', 'chunk_id', 'chunk_text', {'f0': _term('beacon'), 'f1': _term('retry')}, 'f0 > 0 OR f1 > 0', ['f0', 'f1'])}) SELECT h.chunk_id AS note_id, h.bm25 FROM h JOIN notes n ON n.note_id = h.chunk_id WHERE superseded_by IS NULL AND (project_id = 3 OR project_id IS NULL) ORDER BY h.bm25, note_id LIMIT 10")
def app2_search_notes(spark: SparkSession, d: str) -> DataFrame:
    notes = _notes(spark, d)
    index = fulltext.index_of(store.note_texts(notes), f"{d}/notes", "note_id", "text")
    return _rounded(store.search_notes(notes, "beacon OR retry", 3, index=index).select("note_id", "bm25"), "bm25")


# -- training data that isn't text ------------------------------------------------------------------
@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.drift_report(table(spark, d, "log_lines"), table(spark, d, "field_catalog"))


@query()
def p5_table(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.one_table(table(spark, d, "log_lines"), table(spark, d, "field_catalog"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks for a keyword question over all projects."""
    return named.search_chunks(chunk_index(spark, sf_dir), table(spark, sf_dir, "chunks"), sess(spark, sf_dir), "planner OR retry")


def queries() -> dict[str, Query]:
    from . import entries  # noqa: F401  (it registers its own)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import entries  # noqa: F401

    return dict(_SQL)
