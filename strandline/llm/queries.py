"""The queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.sources.tables import table

from . import conversations, corpus_encoding, garbled, mixing, neighbours, secrets, splitting


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.dropped_sessions(table(spark, sf_dir, "log_lines"))


def p1_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the speaker as the role; the part is told by role and kind."""
    c = conversations.conversations(table(spark, sf_dir, "log_lines"))
    return c.select("conversation_id", "seq", c.speaker.alias("role"), "kind", "instant", "line_no", "line_id", "message_hash", "message")


def p1_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as the links alone give them: no session id is looked at."""
    return conversations.linked_conversations(table(spark, sf_dir, "log_lines"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf_dir, "embed_responses"))


def p2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_any(table(spark, sf_dir, "embed_responses"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.lines_with_secrets(table(spark, sf_dir, "log_lines"))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.redact_lines(table(spark, sf_dir, "log_lines"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(table(spark, sf_dir, "log_lines"))


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_log_items(table(spark, sf_dir, "log_lines"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_encoding.encode_corpus(spark, table(spark, sf_dir, "documents"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.garbled_documents(table(spark, sf_dir, "documents"))


def p8_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled.restore_texts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_conversations, p1_linked, p2_found, p2_nearest, p3_found, p3_redacted, p4_found, p4_pieces, p6_ids, p7_mixture, p7_shares, p8_found, p8_restored)}


#: The messages of claude-code lines: line_id, line_no, o (the line), m (its message).
MESSAGE_SQL = """lines AS (
    SELECT line_id, line_no, CAST(raw_line AS JSON) AS o FROM log_lines WHERE agent = 'claude-code' AND raw_line LIKE '%{%' AND json_valid(raw_line)),
said AS (SELECT line_id, line_no, o, o->'message' AS m FROM lines WHERE json_type(o) = 'OBJECT' AND json_type(o->'message') = 'OBJECT'),
blocks AS (
    SELECT line_id, line_no, o, m, unnest(CAST(m->'content' AS JSON[])) AS b, unnest(range(CAST(json_array_length(m->'content') AS BIGINT))) AS block_no
    FROM said WHERE json_type(m->'content') = 'ARRAY')"""

P1_LINKED_SQL = f"""WITH RECURSIVE {MESSAGE_SQL},
ends AS (
    SELECT DISTINCT line_id, CASE b->>'type' WHEN 'tool_use' THEN b->'id' ELSE b->'tool_use_id' END AS link
    FROM blocks WHERE json_type(b) = 'OBJECT' AND b->>'type' IN ('tool_use', 'tool_result')
    UNION SELECT line_id, o->k FROM said, (VALUES ('uuid'), ('parentUuid')) v(k) WHERE json_type(o->k) = 'VARCHAR'),
links AS (SELECT line_id, link FROM ends WHERE json_type(link) = 'VARCHAR'),
steps AS (SELECT DISTINCT a.line_id AS a, b.line_id AS b FROM links a JOIN links b USING (link)),
reach AS (SELECT line_id AS a, line_id AS b FROM said UNION SELECT r.a, s.b FROM reach r JOIN steps s ON r.b = s.a)
SELECT a AS line_id, min(b) AS conversation_id FROM reach GROUP BY a"""

P4_FOUND_SQL = f"""WITH {MESSAGE_SQL},
parts AS (
    SELECT line_id, block_no, unnest(CASE json_type(b->'content') WHEN 'VARCHAR' THEN [b->'content'] WHEN 'ARRAY' THEN CAST(b->'content' AS JSON[]) ELSE CAST([] AS JSON[]) END) AS p
    FROM blocks WHERE json_type(b) = 'OBJECT' AND b->>'type' = 'tool_result'),
sizes AS (
    SELECT line_id, block_no, sum(length(CASE json_type(p) WHEN 'VARCHAR' THEN p->>'$' WHEN 'OBJECT' THEN CASE json_type(p->'text') WHEN 'VARCHAR' THEN p->>'text' END END)) AS n FROM parts GROUP BY line_id, block_no
    UNION ALL SELECT line_id, block_no, length(b->>'text') FROM blocks WHERE json_type(b) = 'OBJECT' AND b->>'type' = 'text' AND json_type(b->'text') = 'VARCHAR')
SELECT line_id, block_no FROM sizes WHERE n > 4000"""

P1_FOUND_SQL = f"""WITH {MESSAGE_SQL},
seen AS (SELECT DISTINCT o->>'sessionId' AS sid FROM lines WHERE json_type(o) = 'OBJECT' AND json_type(o->'sessionId') = 'VARCHAR' AND o->>'sessionId' <> ''),
own AS (
    SELECT o->>'sessionId' AS sid, m->>'role' AS role, m->'content' AS content, line_no, line_id,
        CASE WHEN json_type(o->'timestamp') = 'VARCHAR' AND o->>'timestamp' LIKE '____-__-__%' THEN try_cast(CASE WHEN regexp_matches(o->>'timestamp', '(Z|[+-]\\d\\d:?\\d\\d)$') THEN o->>'timestamp' ELSE (o->>'timestamp') || 'Z' END AS TIMESTAMPTZ) END AS instant
    FROM said WHERE json_type(o->'sessionId') = 'VARCHAR' AND o->>'sessionId' <> ''),
msgs AS (SELECT sid, role, content, instant, min(line_no) AS line_no FROM own GROUP BY sid, role, content, instant),
kinds AS (
    SELECT *, CASE WHEN coalesce(role, '') NOT IN ('user', 'assistant') OR instant IS NULL THEN 'bad'
        WHEN CASE json_type(content) WHEN 'VARCHAR' THEN regexp_matches(content->>'$', '\\S') WHEN 'ARRAY' THEN
            len(list_filter(CAST(content AS JSON[]), lambda b: json_type(b) = 'OBJECT' AND b->>'type' = 'text' AND json_type(b->'text') = 'VARCHAR' AND regexp_matches(b->>'text', '\\S'))) > 0 END
        THEN CASE role WHEN 'user' THEN 'prompt' ELSE 'reply' END ELSE 'other' END AS kind
    FROM msgs),
firsts AS (SELECT sid, arg_min(kind, (instant, line_no)) AS kind FROM kinds WHERE instant IS NOT NULL GROUP BY sid),
spoken AS (SELECT sid, kind, lead(kind) OVER (PARTITION BY sid ORDER BY instant, line_no) AS following FROM kinds WHERE kind IN ('prompt', 'reply')),
tools AS (
    SELECT sid, instant, line_no, b->>'type' AS what, CASE b->>'type' WHEN 'tool_use' THEN b->>'id' ELSE b->>'tool_use_id' END AS tool
    FROM (SELECT sid, instant, line_no, unnest(CAST(content AS JSON[])) AS b FROM kinds WHERE json_type(content) = 'ARRAY')
    WHERE json_type(b) = 'OBJECT' AND b->>'type' IN ('tool_use', 'tool_result')),
calls AS (SELECT sid, tool, min((instant, line_no)) FILTER (what = 'tool_use') AS call, min((instant, line_no)) FILTER (what = 'tool_result') AS result FROM tools GROUP BY sid, tool)
SELECT sid AS native_id FROM seen WHERE sid NOT IN (SELECT sid FROM kinds WHERE kind = 'prompt') OR sid NOT IN (SELECT sid FROM kinds WHERE kind = 'reply')
UNION SELECT sid FROM kinds WHERE kind = 'bad'
UNION SELECT sid FROM firsts WHERE kind <> 'prompt'
UNION SELECT sid FROM spoken WHERE kind = 'prompt' AND coalesce(following, 'prompt') = 'prompt'
UNION SELECT sid FROM calls WHERE tool IS NULL OR call IS NULL OR result IS NULL OR call >= result"""


#: Brute force; ties go to the lower id, as in the operator.
P2_FOUND_SQL = """WITH one AS (
    SELECT chunk_id, embeddings[1] AS e FROM embed_responses WHERE len(embeddings) = 1 AND chunk_id IS NOT NULL AND len(embeddings[1]) = 64
      AND len(list_filter(embeddings[1], lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embeddings[1], lambda x: x <> 0)) > 0),
v AS (SELECT chunk_id, list_transform(any_value(e), lambda x: x::DOUBLE) AS e FROM one GROUP BY chunk_id),
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.chunk_id <> b.chunk_id),
r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY round(s, 7) DESC, b) AS k FROM p)
SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM r WHERE k <= 5 AND s >= 0.9"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND_SQL, "p1_linked": P1_LINKED_SQL, "p2_found": P2_FOUND_SQL, "p4_found": P4_FOUND_SQL}
