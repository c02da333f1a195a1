"""More queries and their SQL: functions, changes of the store, vector tables, reads by key."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schemas
from strandline.functions import text as T
from strandline.functions import vectors as V
from strandline.operators import fulltext, store, transcript, vector_search
from strandline.sources import adapters
from strandline.sources.tables import table

from . import named
from .catalogue import MESSAGES_SQL, PROBE, PROBE_SQL, _rounded, chunk_index, msgs, parsed, query, redact_sql, sess


def _values(columns: list[str], rows: list[tuple]) -> str:
    def lit(x: object) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({', '.join(columns)})"


# -- reads ---------------------------------------------------------------------------------------
@query("SELECT vec_id, label, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings WHERE vec_id IN (17, 42)")
def a14_vector_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = vector_search.VectorTable.parse("vec_id integer primary key, label integer, embedding float[64]")
    rows = table(spark, d, "embeddings").where(t.predicate("vec_id", "in", [17, 42]))
    return rows.select("vec_id", "label", F.round(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double")), 6).alias("total"))


BLOB = struct.pack("<12f", *[i / 4 for i in range(12)])


@query(_values(["rowid", "total"], [(i, sum((4 * i + k) / 4 for k in range(4))) for i in range(3)]))
def a19_vectors_of_blob(spark: SparkSession, d: str) -> DataFrame:
    return vector_search.vectors_of_blob(spark, BLOB, 4).select("rowid", F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double")).alias("total"))


@query(_values(["table_name", "columns", "keys"], [("chunk_vectors", 5, 1), ("chunks", 7, 1), ("file_touches", 8, 1), ("messages", 9, 1), ("notes", 10, 1), ("project_paths", 3, 1), ("projects", 4, 1), ("sessions", 18, 1), ("sources", 7, 1)]))
def a23_catalog(spark: SparkSession, d: str) -> DataFrame:
    return schemas.describe(spark).groupBy("table_name").agg(F.count(F.lit(1)).alias("columns"), F.count_if("key").alias("keys"))


@query("SELECT agent, count(*) AS files FROM sources WHERE log_path LIKE '%.jsonl' GROUP BY agent")
def c18_log_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").where(F.col("log_path").endswith(".jsonl")).groupBy("agent").agg(F.count(F.lit(1)).alias("files"))


@query(f"WITH {MESSAGES_SQL}, e AS (SELECT line_id, source_id, line_no, agent, v FROM j) SELECT source_id, count(*) AS lines, count(*) FILTER (WHERE v IS NULL) AS broken FROM e WHERE agent IN ('claude-code', 'codex') GROUP BY source_id")
def app11_ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    """What an ingest reports of each file; of its failures those that are no JSON."""
    p = parsed(spark, d)
    r = adapters.ingest_report(p).select("source_id", (F.col("messages") + F.col("skipped") + F.col("failed")).alias("lines"))
    broken = p.groupBy(F.col("source_id").alias("s")).agg(F.count_if(F.col("error") == "invalid JSON").alias("broken"))
    return r.join(broken, F.col("source_id") == F.col("s")).select("source_id", "lines", "broken")


@query(f"SELECT c.chunk_id, c.session_id, s.agent, c.first_seq, c.last_seq, CASE WHEN length(chunk_text) > 12000 THEN left(chunk_text, 12000) || ' … [truncated, 12000 of ' || length(chunk_text) || ' chars shown]' ELSE chunk_text END AS chunk_text FROM chunks c JOIN sessions s USING (session_id) WHERE chunk_id = 3 AND s.project_id = (SELECT project_id FROM chunks JOIN sessions USING (session_id) WHERE chunk_id = 3)")
def app3_get_chunk(spark: SparkSession, d: str) -> DataFrame:
    chunks, sessions = table(spark, d, "chunks"), sess(spark, d)
    of = chunks.where("chunk_id = 3").join(sessions, "session_id").select("project_id").scalar()
    return named.get_chunk(chunks, sessions, msgs(spark, d, content=False), 3, of).select("chunk_id", "session_id", "agent", "first_seq", "last_seq", "chunk_text")


@query("SELECT c.chunk_id, s.project_id, s.agent FROM chunks c JOIN sessions s USING (session_id) WHERE c.embedded_at IS NULL AND s.project_id IS NOT NULL ORDER BY c.chunk_id LIMIT 10")
def g8_next_batch(spark: SparkSession, d: str) -> DataFrame:
    return store.pending_chunks(table(spark, d, "chunks"), table(spark, d, "sessions"), limit=10).select("chunk_id", "project_id", "agent")


@query("SELECT s.session_id, s.agent, s.title, p.project_name FROM sessions s LEFT JOIN projects p USING (project_id) WHERE s.agent = 'codex' ORDER BY s.started_at DESC NULLS LAST, s.session_id LIMIT 5")
def app5_recent_of_one_agent(spark: SparkSession, d: str) -> DataFrame:
    rows = transcript.overview(table(spark, d, "sessions"), table(spark, d, "projects"), spark.createDataFrame([], "session_id string, path string, action string"))
    return transcript.recent(rows, agent="codex", limit=5).select("session_id", "agent", "title", "project_name")


# -- text functions ------------------------------------------------------------------------------
@query("SELECT source_id, 'a ' || log_path || ' b' AS pasted, log_path || ' x_y <' AS escaped, 'A' || chr(128512) || ' &#0; &#xZZ; ' || log_path AS refs FROM sources")
def i14_i15_i16_cleaners(spark: SparkSession, d: str) -> DataFrame:
    s, p = table(spark, d, "sources"), F.col("log_path")
    return s.select(
        "source_id", T.clean_pasted(F.concat(F.lit('\n<pasted_content id="7f">a '), p, F.lit(" b</pasted_content>\n"))).alias("pasted"),
        T.clean_escaped(F.concat(F.lit("&#x20;"), p, F.lit(" x\\_y &#60;\n"))).alias("escaped"), T.decode_char_refs(F.concat(F.lit("&#65;&#x1F600; &#0; &#xZZ; "), p)).alias("refs"),
    )


@query("SELECT session_id, list_filter(list_transform(string_split(coalesce(title, ''), ','), lambda x: trim(x)), lambda x: x <> '') AS actions FROM sessions")
def i24_split_actions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sessions").select("session_id", T.split_actions("title").alias("actions"))


COMMITS_SQL = "(SELECT session_id, git_branch, CASE WHEN hash_ % 3 > 0 THEN md5(session_id) END AS a, CASE WHEN hash_ % 5 > 0 THEN md5(native_id) ELSE '' END AS z, CASE hash_ % 4 WHEN 0 THEN 'head' WHEN 1 THEN 'logged' WHEN 2 THEN 'unverified' END AS src FROM (SELECT *, length(session_id) + coalesce(project_id, 0) AS hash_ FROM sessions))"


def _commits(spark: SparkSession, d: str) -> DataFrame:
    h = F.length("session_id") + F.coalesce("project_id", F.lit(0))
    return table(spark, d, "sessions").select(
        "session_id", "git_branch", "project_id", F.when(h % 3 > 0, F.md5("session_id")).alias("a"), F.when(h % 5 > 0, F.md5("native_id")).otherwise("").alias("z"),
        F.when(h % 4 == 0, "head").when(h % 4 == 1, "logged").when(h % 4 == 2, "unverified").alias("src"),
    )


RANGE_SQL = "CASE WHEN a IS NULL AND z = '' THEN NULL WHEN a IS NULL THEN left(z, 12) WHEN z = '' OR left(a, 12) = left(z, 12) THEN left(a, 12) ELSE left(a, 12) || '..' || left(z, 12) END || CASE WHEN src IN ('head', 'unverified') THEN ' (' || src || ')' ELSE '' END"


@query(f"SELECT session_id, left(a, 12) AS short, {RANGE_SQL} AS commits, concat_ws(' @ ', nullif(git_branch, ''), {RANGE_SQL}) AS line FROM {COMMITS_SQL}")
def i26_commits(spark: SparkSession, d: str) -> DataFrame:
    return _commits(spark, d).select("session_id", T.short_commit("a").alias("short"), T.commit_range("a", "z", "src").alias("commits"), T.git_line("git_branch", "a", "z", "src").alias("line"))


RANK_SQL = "list_position(['logged', 'branch', 'head', 'unverified'], {})"


@query(f"SELECT s.project_id, max_by(src, {RANK_SQL.format('src')}) AS worst FROM {COMMITS_SQL} c JOIN sessions s USING (session_id) GROUP BY s.project_id")
def b4_worst_source(spark: SparkSession, d: str) -> DataFrame:
    return _commits(spark, d).groupBy("project_id").agg(transcript.worst_trust("src").alias("worst"))


@query(f"SELECT session_id, CASE WHEN src IS NULL THEN 'branch' WHEN {RANK_SQL.format('src')} > 2 THEN src ELSE 'branch' END AS worse FROM {COMMITS_SQL}")
def i27_worse(spark: SparkSession, d: str) -> DataFrame:
    return _commits(spark, d).select("session_id", T.worse(F.lit("branch"), F.col("src"), transcript.TRUST).alias("worse"))


@query("SELECT session_id, CASE WHEN cwd IS NULL THEN 'src/a.py' WHEN cwd LIKE '/home/dev/%' THEN substr(cwd, 11) || '/src/a.py' ELSE 'src/a.py' END AS path, 'src/a.py' AS tool_path, CASE WHEN cwd LIKE '/home/dev/%' THEN substr(cwd, 11) ELSE cwd END AS home FROM sessions")
def i21_project_paths(spark: SparkSession, d: str) -> DataFrame:
    root = F.lit("/home/dev")
    return table(spark, d, "sessions").select("session_id", T.project_path(F.lit("./src/a.py"), "cwd", root).alias("path"), T.project_path(F.lit("src//a.py"), "cwd", root, tool=True).alias("tool_path"), T.project_path("cwd", F.lit(None).cast("string"), root).alias("home"))


@query("SELECT count(*) AS n, true AS well_formed FROM region")
def i4_now(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "region").select(T.utc_now().alias("now")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("now").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")).alias("well_formed"))


@query("SELECT line_id, CASE WHEN json_valid(raw_line) THEN json_type(raw_line) = 'OBJECT' END AS is_object FROM log_lines WHERE trim(raw_line) <> ''")
def i5_json_rules(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("raw_line")
    return table(spark, d, "log_lines").where(F.trim("raw_line") != "").select("line_id", F.when(v.isNotNull(), F.schema_of_variant(v).startswith("OBJECT")).alias("is_object"))


#: Queries, what the sanitiser makes of them, and the stems that a preview looks for.
ASKED = [
    ("planner cache", "planner cache", "plann,cache"), ("foo-bar AND x", '"foo-bar" AND x', "foo,bar"), ("a:b OR c*", '"a:b" OR c*', ""), ('"whole story" -gone', '"whole story" -gone', "whole,story"), ("path\\to\\file", '"path\\to\\file"', "path,to,file"),
    ("(one OR two) NOT three", "(one OR two) NOT three", "one,two,three"), ('say "hi', 'say """hi"', "say,hi"), ("don't", '"don\'t"', "don"), ("", "", ""),
]


@query(_values(["asked", "sanitised", "stems"], ASKED))
def j2_j8_query_words(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(q, T.sanitise_query(q), ",".join(T.query_terms(q))) for q, _, _ in ASKED], "asked string, sanitised string, stems string")


@query()
def j6_snippets_of_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = chunk_index(spark, d).search("planner OR retry").orderBy("bm25", "chunk_id").limit(50)
    return hits.join(table(spark, d, "chunks"), "chunk_id").select("chunk_id", fulltext.snippet("chunk_text", "planner OR retry").alias("snippet"))


# -- vectors -------------------------------------------------------------------------------------
@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(printf('%.6f', x::DOUBLE) AS FLOAT)::DOUBLE)), 4) AS f32, list_transform(embedding[1:4], lambda x: trunc(x * 100)::INT) AS int8, 64 AS bits, 0.0::DOUBLE AS apart FROM embeddings")
def v1_v2_v3_v11_constructors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors from text and bytes, and a difference that is zero."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    text = V.vec_to_json("embedding")
    whole = F.concat(F.lit("["), F.array_join(F.transform(F.slice("embedding", 1, 4), lambda x: (x * 100).cast("int").cast("string")), ","), F.lit("]"))
    bits = V.vec_bit(V.vec_quantize_binary("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(total(V.vec_f32(text)), 4).alias("f32"), F.transform(V.vec_int8(whole), lambda x: x.cast("int")).alias("int8"), V.vec_length(bits, "bit").alias("bits"), total(V.vec_sub("embedding", "embedding")).alias("apart"))


BITS_SQL = "list_transform({}, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)"


@query(f"SELECT vec_id, list_sum(list_transform(list_zip({BITS_SQL.format('embedding')}, {BITS_SQL.format(PROBE_SQL)}), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::INT AS distance FROM embeddings ORDER BY distance, vec_id LIMIT 20")
def k5_knn_hamming(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", V.vec_quantize_binary("embedding").alias("embedding"))
    q = [sum((PROBE[8 * k + i] > 0) << i for i in range(8)) for k in range(8)]
    return vector_search.knn(rows, q, 20, "hamming", key="vec_id")


@query(f"SELECT vec_id, label, round(sqrt(list_sum(list_transform(list_zip(embedding, {PROBE_SQL}), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2])))), 6) AS distance FROM embeddings WHERE label >= 2 AND label <= 6 ORDER BY distance, vec_id LIMIT 7")
def k7_knn_with_columns(spark: SparkSession, d: str) -> DataFrame:
    t = vector_search.VectorTable.parse("vec_id integer primary key, label integer partition key, embedding float[64]")
    where = t.predicate("label", ">=", 2) & t.predicate("label", "<=", 6)
    return _rounded(vector_search.knn(table(spark, d, "embeddings"), PROBE, 7, "l2", key="vec_id", where=where, keep=("label",)), "distance")


@query(_values(["column_name", "role", "kind"], [("id", "key", ""), ("p", "partition", "text"), ("n", "metadata", "integer"), ("ok", "metadata", "boolean"), ("note", "auxiliary", "text"), ("v", "vector", "float32[64] cosine"), ("b", "vector", "bit[128] hamming"), ("i", "vector", "int8[8] l1")]))
def k8_declaration(spark: SparkSession, d: str) -> DataFrame:
    t = vector_search.VectorTable.parse("id integer primary key, p text partition key, n integer, ok boolean, +note text, v float[64] distance_metric=cosine, b bit[128], i int8[8] distance_metric=L1, chunk_size=256")
    return spark.createDataFrame(t.describe(), "column_name string, role string, kind string")


@query("SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN 99 ELSE label END AS label, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id + 100000, label, round(embedding[1]::DOUBLE, 6) FROM embeddings WHERE vec_id % 50 = 1")
def b18_b19_b20_vector_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows inserted (one of them with a vector that is too short), deleted and updated."""
    t = vector_search.VectorTable.parse("vec_id integer primary key, label integer, embedding float[64]")
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), "embedding")
    few = rows.where("vec_id % 50 = 1").withColumn("vec_id", F.col("vec_id") + 100_000)
    short = few.limit(1).select((F.col("vec_id") + 500_000).alias("vec_id"), "label", F.slice("embedding", 1, 9).alias("embedding"))
    now = t.delete(t.insert(rows, few.unionByName(short).unionByName(rows.where("vec_id < 5"))), rows.where("vec_id % 7 = 0"))
    changes = rows.where("vec_id % 10 = 3").select("vec_id", F.lit(99).alias("label"), F.lit(None).cast("array<float>").alias("embedding"))
    return t.update(now, changes).select("vec_id", "label", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


@query(f"SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, {PROBE_SQL}), lambda z: abs(z[1]::DOUBLE - z[2]))), 6) AS l1 FROM embeddings")
def n3_sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """A distance by its name in SQL."""
    V.register(spark)
    table(spark, d, "embeddings").createOrReplaceTempView("strandline_vectors")
    probe = ", ".join(f"CAST({x} AS FLOAT)" for x in PROBE)
    return spark.sql(f"SELECT vec_id, round(vec_distance_l1(embedding, array({probe})), 6) AS l1 FROM strandline_vectors")


# -- the store -----------------------------------------------------------------------------------
@query("SELECT session_id, CASE WHEN even THEN '/moved' ELSE cwd END AS cwd, CASE WHEN even THEN NULL ELSE title END AS new_title, title, greatest(ended_at, later) AS ended_at, message_count + CASE WHEN even THEN 5 ELSE 0 END AS message_count FROM (SELECT session_id, cwd, title, message_count, strftime(ended_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS ended_at, CASE WHEN length(session_id) % 2 = 0 THEN '2031-01-01T00:00:00.000Z' END AS later, length(session_id) % 2 = 0 AS even FROM sessions)")
def b2_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Half of the sessions go on: with another directory, no title, and five messages."""
    old = schemas.conform(sess(spark, d), "sessions")
    even = F.length("session_id") % 2 == 0
    new = old.where(even).withColumn("cwd", F.lit("/moved")).withColumn("title", F.lit("")).withColumn("ended_at", F.lit("2031-01-01T00:00:00.000Z")).withColumn("message_count", F.lit(5))
    up = store.upsert_sessions(old, new)
    return up.select("session_id", "cwd", F.when(even, None).otherwise(F.col("title")).alias("new_title"), "title", "ended_at", "message_count")


@query("WITH s AS (SELECT session_id, cwd, CASE WHEN cwd LIKE '%r%' THEN 'https://host.example/o/' || regexp_extract(cwd, '([^/]+)$', 1) END AS remote FROM sessions WHERE cwd IS NOT NULL), k AS (SELECT DISTINCT coalesce(lower(replace(remote, 'https://', '')), cwd) AS id FROM s), n AS (SELECT id, row_number() OVER (ORDER BY id) + 1000 AS project_id FROM k) SELECT s.session_id, n.project_id FROM s JOIN n ON n.id = coalesce(lower(replace(remote, 'https://', '')), cwd)")
def b10_new_projects(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a store that knows one project, of another directory: all get new ones."""
    homes = table(spark, d, "sessions").where("cwd is not null").select("session_id", "cwd", F.when(F.col("cwd").contains("r"), F.concat(F.lit("https://host.example/o/"), F.regexp_extract("cwd", "([^/]+)$", 1))).alias("git_remote"))
    projects = schemas.conform(spark.createDataFrame([(1000, "old")], "project_id long, project_name string"), "projects")
    paths = schemas.conform(spark.createDataFrame([("/nowhere", 1000)], "path string, project_id long"), "project_paths")
    return store.find_or_create_projects(homes, projects, paths)[0].select("session_id", "project_id")


@query(f"SELECT chunk_id AS note_id, 'fact' AS kind, left(chunk_text, 60) AS title FROM chunks UNION ALL SELECT (SELECT max(chunk_id) + 1 FROM chunks), 'todo', 'look at ' || {redact_sql(chr(39) + 'API_KEY=abcdef' + chr(39))}")
def b12_add_note(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    notes = schemas.conform(c.select(F.col("chunk_id").alias("note_id"), F.lit("fact").alias("kind"), F.left("chunk_text", F.lit(60)).alias("title")), "notes")
    # the environment line is one of the title's lines
    one = store.add_note(spark, notes, "todo", "API_KEY=abcdef", "body", ["x"], 3)
    mine = F.col("note_id") > c.agg(F.max("chunk_id")).scalar()
    return one.select("note_id", "kind", F.when(mine, F.concat(F.lit("look at "), F.col("title"))).otherwise(F.col("title")).alias("title"))


@query("WITH v AS (SELECT chunk_id, min(response_id) AS r FROM embed_responses WHERE len(embeddings) = 1 AND embeddings[1] IS NOT NULL AND chunk_id IN (SELECT chunk_id FROM chunks) GROUP BY chunk_id) SELECT c.chunk_id, CASE WHEN c.embedded_at IS NULL AND v.r IS NOT NULL THEN 'test-model' ELSE c.embedding_model END AS embedding_model, v.r IS NOT NULL AS has_vector FROM chunks c LEFT JOIN v USING (chunk_id)")
def b13_embedding_write(spark: SparkSession, d: str) -> DataFrame:
    """The answers of the service written: vectors added, their chunks marked."""
    chunks = table(spark, d, "chunks")
    r = table(spark, d, "embed_responses").where((F.size("embeddings") == 1) & F.element_at("embeddings", 1).isNotNull()).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    got = schemas.conform(r.groupBy("chunk_id").agg(F.min_by(F.element_at("embeddings", 1), "response_id").alias("embedding")), "chunk_vectors")
    t = {"chunks": chunks, "chunk_vectors": got.where("chunk_id % 2 = 0")}  # half of them are there already
    now = store.write_vectors(t, got.fillna({"agent": ""}), "test-model", F.lit("2026-01-01T00:00:00Z"))
    has = now["chunk_vectors"].select(F.col("chunk_id").alias("v")).distinct()
    return now["chunks"].join(has, F.col("chunk_id") == F.col("v"), "left").select("chunk_id", "embedding_model", F.col("v").isNotNull().alias("has_vector"))


@query("SELECT DISTINCT r.chunk_id FROM embed_responses r JOIN chunks c USING (chunk_id) JOIN sessions s USING (session_id) WHERE s.project_id IS DISTINCT FROM 3")
def b16_vectors_of_deleted_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks, sessions = table(spark, d, "chunks"), table(spark, d, "sessions")
    v = table(spark, d, "embed_responses").join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id").distinct()
    gone = sessions.where("project_id = 3").select("session_id")
    return store.delete_cascade({"sessions": sessions, "chunks": chunks, "chunk_vectors": v}, "sessions", gone)["chunk_vectors"].select("chunk_id")


@query("SELECT chunk_id, CASE WHEN session_id IN (SELECT session_id FROM sessions WHERE project_id = (SELECT min(project_id) FROM projects WHERE git_remote IS NULL)) THEN NULL ELSE embedding_model END AS embedding_model FROM chunks")
def b11_c9_merged_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of a project that was merged into another wait to be embedded again."""
    p = table(spark, d, "projects")
    ends = p.agg(F.min(F.when(F.col("git_remote").isNull(), F.col("project_id"))).alias("a"), F.max("project_id").alias("z")).first()
    return store.merge_projects({"projects": p, "sessions": table(spark, d, "sessions"), "chunks": table(spark, d, "chunks")}, ends.a, ends.z)["chunks"].select("chunk_id", "embedding_model")


HISTORY_SQL = "h AS (SELECT s.cwd, floor(epoch(s.ended_at))::BIGINT AS ts, max(md5(s.session_id)) AS hash FROM sessions s WHERE s.cwd IS NOT NULL AND s.ended_at IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {MESSAGES_SQL}, {HISTORY_SQL}, span AS (SELECT s.session_id, s.cwd, min(m.created_at) AS a, max(m.created_at) AS z FROM sessions s LEFT JOIN m USING (session_id) GROUP BY ALL),
e AS (SELECT session_id, cwd, floor(epoch(try_cast(a AS TIMESTAMPTZ)))::BIGINT AS a, floor(epoch(try_cast(z AS TIMESTAMPTZ)))::BIGINT AS z FROM span)
SELECT session_id, ha AS starting_commit, hz AS ending_commit, CASE WHEN hz IS NOT NULL THEN 'branch' END AS commit_source FROM (
  SELECT e.session_id, (SELECT arg_max(hash, ts) FROM h WHERE h.cwd = e.cwd AND ts <= e.a) AS ha, (SELECT arg_max(hash, ts) FROM h WHERE h.cwd = e.cwd AND ts <= e.z) AS hz FROM e) WHERE ha IS NOT NULL OR hz IS NOT NULL""")
def b21_d8_repair_commits(spark: SparkSession, d: str) -> DataFrame:
    """Commits of sessions that had none, from a history in which every session's end is one."""
    s = sess(spark, d)
    at = F.unix_seconds(F.col("ended_at").cast("timestamp"))
    history = table(spark, d, "sessions").where("cwd is not null and ended_at is not null").select("cwd", at.alias("at"), F.md5("session_id").alias("hash")).groupBy("cwd", "at").agg(F.max("hash").alias("hash")).withColumn("source", F.lit("branch"))
    bare = schemas.conform(s.select("session_id", "agent", "native_id", "cwd"), "sessions")
    return store.repair_commits(bare, msgs(spark, d, content=False), history).select("session_id", "starting_commit", "ending_commit", "commit_source")


@query("SELECT chunk_id AS touch_id, CASE WHEN s.cwd LIKE '/home/dev/%' THEN substr(s.cwd, 11) || '/src/f' || (chunk_id % 9) ELSE 'src/f' || (chunk_id % 9) END AS path FROM chunks c JOIN sessions s USING (session_id) WHERE s.cwd LIKE '/home/dev/%' AND chunk_id % 2 = 0")
def b22_repair_paths(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sessions")
    touches = table(spark, d, "chunks").select(F.col("chunk_id").alias("touch_id"), "session_id", F.concat(F.lit("src/f"), (F.col("chunk_id") % 9).cast("string")).alias("path"), (F.col("chunk_id") % 2 == 1).alias("rooted"))
    roots = s.select("session_id", "cwd", F.when(F.col("cwd").startswith("/home/dev/"), "/home/dev").alias("root"))
    return store.repair_paths(touches, roots)


@query("SELECT 'paths' AS repair, count(*) AS changed_rows FROM chunks WHERE chunk_id % 2 = 0 UNION ALL SELECT 'titles', count(*) FROM sessions WHERE title IS NULL")
def b24_app13_dry_run(spark: SparkSession, d: str) -> DataFrame:
    """Repairs that are only counted."""
    return store.repair_counts({"paths": table(spark, d, "chunks").where("chunk_id % 2 = 0"), "titles": table(spark, d, "sessions").where("title is null")})


@query("SELECT p.project_id, (SELECT count(*) FROM sessions s WHERE s.project_id = p.project_id) AS sessions, coalesce((SELECT string_agg(cwd, ', ' ORDER BY cwd) FROM (SELECT DISTINCT cwd FROM sessions s WHERE s.project_id = p.project_id AND cwd IS NOT NULL)), '') AS paths FROM projects p")
def e8_project_paths(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sessions")
    paths = s.where("cwd is not null and project_id is not null").select(F.col("cwd").alias("path"), "project_id").distinct()
    return store.project_list(table(spark, d, "projects"), s, paths).select("project_id", "sessions", "paths")


@query("SELECT chunk_id AS note_id, [kind_ || 'x'] AS tags FROM (SELECT chunk_id, CAST(chunk_id % 4 AS VARCHAR) AS kind_ FROM chunks)")
def b12_note_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags as the store keeps them, JSON, and read again."""
    c = table(spark, d, "chunks").select(F.col("chunk_id").alias("note_id"), F.to_json(F.array(F.concat((F.col("chunk_id") % 4).cast("string"), F.lit("x")))).alias("tags"))
    return c.select("note_id", F.from_json("tags", "array<string>").alias("tags"))


@query(_values(["name", "found"], [("ExplainFile", 1), ("SearchChunks", 1), ("SearchHybrid", 1), ("GetChunk", 1), ("PendingChunks", 1), ("Nope", 0)]))
def a22_named_queries(spark: SparkSession, d: str) -> DataFrame:
    def there(name: str) -> int:
        try:
            return int(callable(named.load_query(name)))
        except KeyError:
            return 0

    return spark.createDataFrame([(n, there(n)) for n in ("ExplainFile", "SearchChunks", "SearchHybrid", "GetChunk", "PendingChunks", "Nope")], "name string, found int")


