"""From parsed lines to messages, sessions, file touches and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as T

from .ordered import BLOCK, running_sum, sequence_numbers

# --- fixed values ---------------------------------------------------------------------
#: How far a commit can be trusted; a session keeps the worst.
TRUST = ["logged", "branch", "head", "unverified"]
# ----------------------------------------------------------------------------------------
#: Lines of one file, at most: a multiple of a block's.
FILE_LINES = 10_000_000_000


def session_key(agent: Column | str = "agent", native: Column | str = "native_id") -> Column:
    return F.concat_ws(":", agent, native)


def messages(parsed: DataFrame, redacted: bool = True) -> DataFrame:
    """Numbered messages of every session: message_id, session_id, seq, role, kind,
    tool_name, tool_use_id, content, created_at, touches, source_id, line_no.

    seq counts from 0 in the order of (source_id, line_no); a tool result takes the name
    of the earlier call with its id. Messages without a session id are left out.
    """
    rows = parsed.where((F.col("status") == "message") & F.col("native_id").isNotNull()).withColumn("session_id", session_key())
    # one integer that orders all lines of a session; a block of it is 100,000 lines of a file
    rows = rows.withColumn("pos", F.col("source_id") * F.lit(FILE_LINES) + F.col("line_no"))
    rows = sequence_numbers(rows, ["session_id"], "pos", "seq", ("line_id",), block=BLOCK)
    calls = rows.where((F.col("kind") == "tool_call") & F.col("tool_use_id").isNotNull()).groupBy(F.col("session_id").alias("cs"), F.col("tool_use_id").alias("ct")).agg(F.min(F.struct("seq", "tool_name")).alias("call"))
    rows = rows.join(calls, (F.col("session_id") == F.col("cs")) & (F.col("tool_use_id") == F.col("ct")), "left")
    name = F.when(F.col("kind") == "tool_result", F.when(F.col("call.seq") < F.col("seq"), F.col("call.tool_name"))).otherwise(F.col("tool_name"))
    content = T.redact("content") if redacted else F.col("content")
    return rows.select(F.col("line_id").alias("message_id"), "session_id", "seq", "role", "kind", name.alias("tool_name"), "tool_use_id", content.alias("content"), "created_at", "touches", "source_id", "line_no")


def sessions(parsed: DataFrame, redacted: bool = True) -> DataFrame:
    """One row for each session, folded from what its lines say in order.

    The last non-empty directory, branch and model count; the first line's time begins it
    (its first non-empty one), the greatest ends it; the agent's last title, or else the
    first user text where it stands on the session's first line.
    """
    told = parsed.where(F.col("status").isin("message", "session") & F.col("native_id").isNotNull()).withColumn("session_id", session_key())
    pos = F.struct("source_id", "line_no", "line_id")

    def last(c: str) -> Column:
        return F.max_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", pos)).alias(c)

    made = F.col("status") == "message"
    first = F.min_by(F.struct("role", "kind", F.left("content", F.lit(4 * T.TITLE_CHARS)).alias("content")), pos).alias("f")
    out = told.groupBy("session_id", "agent", "native_id").agg(
        last("cwd"), last("git_branch"), last("model"), last("title"), first,
        F.min_by("cwd", F.when(F.coalesce(F.col("cwd"), F.lit("")) != "", pos)).alias("first_cwd"),
        F.min_by("created_at", F.when(F.coalesce(F.col("created_at"), F.lit("")) != "", pos)).alias("started_at"), F.max("created_at").alias("ended_at"), F.count_if(made).alias("message_count"),
    )
    seeded = F.when((F.col("f.role") == "user") & (F.col("f.kind") == "text") & (F.col("f.content") != ""), T.truncate("f.content"))
    title = F.coalesce("title", seeded)
    return out.select("session_id", "agent", "native_id", "cwd", "git_branch", "model", (T.redact(title) if redacted else title).alias("title"), "first_cwd", "started_at", "ended_at", "message_count")


def worst_trust(c: Column | str) -> Column:
    """The worst of a group's commit sources; empty ones don't count."""
    c = F.col(c) if isinstance(c, str) else c
    return F.max_by(c, F.when(F.array_position(F.array(*map(F.lit, TRUST)), c) > 0, F.array_position(F.array(*map(F.lit, TRUST)), c)))


def file_touches(msgs: DataFrame, homes: DataFrame) -> DataFrame:
    """Exploded touches with project and path below the session's directory.

    ``homes``: session_id, project_id, cwd.
    """
    t = msgs.select("session_id", "message_id", "seq", "created_at", F.posexplode("touches").alias("n", "t"))
    path = T.let(F.struct(F.col("t.path").alias("p"), F.coalesce("cwd", F.lit("")).alias("c")), lambda z: F.when(z["p"].startswith("/") & (z["c"] != ""), T.relative_path(z["p"], z["c"])).otherwise(T.clean_path(z["p"])))
    return t.join(homes.select("session_id", "project_id", "cwd"), "session_id", "left").select("session_id", "message_id", "seq", "project_id", path.alias("path"), F.col("t.action").alias("action"), "created_at", F.lit(True).alias("rooted"))


def chunks(msgs: DataFrame, eager_tail: bool = True, after: DataFrame | None = None) -> DataFrame:
    """Exchanges: session_id, first_seq, last_seq, chunk_text.

    A chunk begins at each user text; a session's last one counts if it is settled, its last
    row that isn't the system's being the assistant's text (``eager_tail``), else only
    when the next has begun. ``after`` (session_id, last_seq) are the chunks that exist:
    only later messages are cut. Chunks without text are left out.
    """
    rows = msgs.select("session_id", "seq", "role", "kind", "content")
    if after is not None:
        done = after.groupBy("session_id").agg(F.max("last_seq").alias("done"))
        rows = rows.join(done, "session_id", "left").where(F.col("done").isNull() | (F.col("seq") > F.col("done"))).drop("done")
    user = (F.col("role") == "user") & (F.col("kind") == "text")
    rows = running_sum(rows, ["session_id"], "seq", F.when(user, 1).otherwise(0).cast("long"), "turn")
    spoken = (F.col("kind") == "text") & F.col("role").isin("user", "assistant")
    said = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col("content"))
    cut = rows.groupBy("session_id", "turn").agg(
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.array_sort(F.collect_list(F.when(spoken, F.struct("seq", said.alias("said"))))).alias("parts"),
        F.max_by(F.struct("role", "kind"), F.when(F.col("role") != "system", F.col("seq"))).alias("tail"),
    )
    last = cut.groupBy(F.col("session_id").alias("ls")).agg(F.max("turn").alias("last_turn"))
    settled = F.coalesce((F.col("tail.role") == "assistant") & (F.col("tail.kind") == "text"), F.lit(False)) if eager_tail else F.lit(False)
    kept = cut.join(last, F.col("session_id") == F.col("ls")).where((F.size("parts") > 0) & ((F.col("turn") < F.col("last_turn")) | settled))
    return kept.select("session_id", "first_seq", "last_seq", F.array_join(F.transform("parts", lambda p: p["said"]), "\n\n").alias("chunk_text"))


def chunk_times(chunk_rows: DataFrame, msgs: DataFrame, session_rows: DataFrame) -> DataFrame:
    """Chunks with ``chunk_at``: the least time of their messages, or else the session's."""
    m = msgs.select(F.col("session_id").alias("ms"), "seq", "created_at")
    inside = chunk_rows.join(m, (F.col("session_id") == F.col("ms")) & F.col("seq").between(F.col("first_seq"), F.col("last_seq")), "left")
    least = inside.groupBy(*chunk_rows.columns).agg(F.min("created_at").alias("least"))
    s = session_rows.select(F.col("session_id").alias("ss"), "started_at")
    return least.join(s, F.col("session_id") == F.col("ss"), "left").select(*chunk_rows.columns, F.coalesce("least", "started_at").alias("chunk_at"))


def page(msgs: DataFrame, session_id: str, from_seq: int = 0, to_seq: int | None = None, include_tools: bool = False, max_chars: int = 20_000) -> DataFrame:
    """A page of a transcript: seq, role, kind, tool_name, content, created_at, next_from_seq.

    At most 200 places of seq, never thinking; texts are cut at 6,000 characters, others
    at 1,500; the page ends before ``max_chars`` (60,000 at most) is passed, yet has a message.
    ``next_from_seq`` is where the next page begins, null at the end.
    """
    rows_cap, text_cap, other_cap, most = 200, 6000, 1500, 60_000
    max_chars = min(max_chars if max_chars > 0 else 20_000, most)
    given = to_seq is not None and 0 < to_seq >= from_seq and to_seq - from_seq < rows_cap
    end = to_seq if given else from_seq + rows_cap - 1
    wanted = msgs.where((F.col("session_id") == session_id) & (F.col("kind") != "thinking") & (F.lit(include_tools) | (F.col("kind") == "text")) & (F.col("seq") >= from_seq))
    from pyspark.sql import Window

    rows = wanted.where(F.col("seq") <= end).withColumn("content", F.when(F.col("kind") == "text", T.cut_with_note("content", text_cap)).otherwise(T.cut_with_note("content", other_cap)))
    w = Window.partitionBy("session_id").orderBy("seq")  # 200 rows at most
    rows = rows.withColumn("used", F.sum(F.length("content")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.row_number().over(w))
    kept = rows.where((F.col("used") <= max_chars) | (F.col("n") == 1))
    shown = kept.agg(F.max("seq")).scalar()
    nxt = wanted.where((F.col("seq") > F.coalesce(shown, F.lit(from_seq - 1))) & (F.lit(not given) | (F.col("seq") <= end))).agg(F.min("seq")).scalar()
    return kept.select("seq", "role", "kind", "tool_name", "content", "created_at", nxt.alias("next_from_seq"))


def first_seq_after(msgs: DataFrame, session_id: str, after: int, include_tools: bool = False) -> DataFrame:
    return msgs.where((F.col("session_id") == session_id) & (F.col("seq") > after) & (F.col("kind") != "thinking") & (F.lit(include_tools) | (F.col("kind") == "text"))).agg(F.min("seq").alias("seq"))


def overview(session_rows: DataFrame, projects: DataFrame, touches: DataFrame) -> DataFrame:
    """Sessions with the project's name and how many files they changed."""
    changed = touches.where("action <> 'read'").groupBy(F.col("session_id").alias("ts")).agg(F.countDistinct("path").alias("files_changed"))
    p = projects.select(F.col("project_id").alias("pp"), "project_name")
    return session_rows.join(p, F.col("project_id") == F.col("pp"), "left").join(changed, F.col("session_id") == F.col("ts"), "left").drop("pp", "ts").withColumn("files_changed", F.coalesce("files_changed", F.lit(0).cast("long")))


def recent(overview_rows: DataFrame, project_id: int | None = None, agent: str | None = None, limit: int = 20) -> DataFrame:
    rows = overview_rows
    if project_id is not None:
        rows = rows.where(F.col("project_id") == project_id)
    if agent is not None:
        rows = rows.where(F.col("agent") == agent)
    return rows.orderBy(F.desc_nulls_last("started_at"), "session_id").limit(limit if limit > 0 else 20)


def sessions_touching(touches: DataFrame, session_rows: DataFrame, path: str, project_id: int | None = None, limit: int = 20) -> DataFrame:
    t = touches.where(F.col("path") == T.clean_path(F.lit(path)))
    if project_id is not None:
        t = t.where(F.col("project_id") == project_id)
    per = t.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"), F.count(F.lit(1)).alias("touches"))
    return per.join(session_rows.select("session_id", "agent", "title", "started_at"), "session_id").orderBy(F.desc_nulls_last("started_at"), "session_id").limit(limit if limit > 0 else 20)


def explain_file(touches: DataFrame, session_rows: DataFrame, chunk_rows: DataFrame, path: str, project_id: int | None = None, limit: int = 10) -> DataFrame:
    """Who touched a file: changed first, then latest; each with the chunk that holds its
    last change (or else read), or the nearest earlier chunk, or the session's first."""
    limit = 10 if limit <= 0 else min(limit, 50)
    t = touches.where(F.col("path") == T.clean_path(F.lit(path)))
    if project_id is not None:
        t = t.where(F.col("project_id") == project_id)
    change = F.col("action") != "read"
    per = t.groupBy("session_id").agg(
        F.array_join(F.array_sort(F.collect_set("action")), ",").alias("actions"),
        F.count(F.lit(1)).alias("touches"),
        F.sum(change.cast("int")).alias("changes"),
        F.max("created_at").alias("last_touch_at"),
        F.max_by("seq", F.when(F.col("message_id").isNotNull(), F.struct(change.alias("c"), "created_at", "message_id"))).alias("anchor_seq"),
    )
    top = per.join(session_rows.select("session_id", "agent", "title", "started_at"), "session_id")
    order = [(F.col("changes") > 0).desc(), F.desc_nulls_last(F.coalesce("last_touch_at", "started_at")), F.col("session_id")]
    top = top.orderBy(*order).limit(limit)
    c = chunk_rows.select(F.col("session_id").alias("cs"), "chunk_id", "first_seq", "last_seq", "chunk_text")
    row = F.struct("chunk_id", "chunk_text")
    a = F.col("anchor_seq")
    near = top.join(c, F.col("session_id") == F.col("cs"), "left").groupBy(*top.columns).agg(
        F.min(F.when(a.between(F.col("first_seq"), F.col("last_seq")), row)).alias("holds"),
        F.max_by(row, F.when(F.col("last_seq") <= a, F.struct("last_seq", "chunk_id"))).alias("earlier"),
        F.min_by(row, F.when(F.col("chunk_id").isNotNull(), F.struct("first_seq", "chunk_id"))).alias("first"),
    )
    best = F.coalesce("holds", "earlier", "first")
    return near.select(*top.columns, best["chunk_id"].alias("chunk_id"), T.compact_preview(best["chunk_text"]).alias("preview")).orderBy(*order)
