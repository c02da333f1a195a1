"""Log lines of two agents as normalised messages: pure projections over a variant.

Both adapters take lines (line_id, source_id, agent, line_no, raw_line) and give one
row for each line: what message it makes (role, kind, ...), what it says of its session,
and ``error`` where it can't be read. ``status`` is message, session, skip or error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators.ordered import carry_forward

# --- fixed values: names in the logs -------------------------------------------------
TOUCH_ACTIONS = {"Read": "read", "Edit": "edit", "MultiEdit": "edit", "Write": "edit"}
PATCH_ACTIONS = {"Update File": "edit", "Add File": "create", "Delete File": "delete", "Move to": "rename"}
PATCH_HEADER = r"^\*\*\* (Update File|Add File|Delete File|Move to): (.*?)\r?$"
# --------------------------------------------------------------------------------------
COLUMNS = ["line_id", "source_id", "agent", "line_no", "status", "native_id", "cwd", "git_branch", "version", "model", "title", "role", "kind", "tool_name", "tool_use_id", "content", "created_at", "touches", "error"]
TOUCHES = "array<struct<path:string,action:string>>"


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once for each row.

    They come out of a generator, through which the optimiser moves neither filters nor
    projections: else a filter on the last of many dependent columns would have the JSON
    parsed anew for every mention of it.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.drop(*columns).select("*", F.inline(F.array(made)))


def _variant(c: Column, path: str) -> Column:
    return F.try_variant_get(c, path, "variant")


def _text(c: Column, path: str) -> Column:
    """A string at a path; null where there is none or something else."""
    v = _variant(c, path)
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(c, path, "string"))


def _kind(c: Column) -> Column:
    """string, array, object, null or other."""
    s = F.schema_of_variant(c)
    return F.when(s == "STRING", "string").when(s.startswith("ARRAY"), "array").when(s.startswith("OBJECT"), "object").when(c.isNull() | F.is_variant_null(c), "null").otherwise("other")


def _blocks(c: Column) -> Column:
    return F.coalesce(F.try_variant_get(c, "$", "array<variant>"), F.array().cast("array<variant>"))


def _typed_parts(c: Column) -> Column:
    """A tool result's text: a string as it is, an array's texts, others named."""
    parts = F.transform(_blocks(c), lambda b: F.when(_text(b, "$.type") == "text", F.coalesce(_text(b, "$.text"), F.lit(""))).otherwise(F.concat(F.lit("["), F.coalesce(_text(b, "$.type"), F.lit("")), F.lit(" content omitted]"))))
    listed = F.try_variant_get(c, "$", "array<variant>").isNotNull()
    return F.when(c.isNull(), "").when(listed, F.array_join(parts, "")).when(_kind(c) == "string", F.try_variant_get(c, "$", "string")).otherwise(F.to_json(c))


def _all_parts(c: Column) -> Column:
    parts = F.transform(_blocks(c), lambda b: F.coalesce(_text(b, "$.text"), F.lit("")))
    listed = F.try_variant_get(c, "$", "array<variant>").isNotNull()
    return F.when(c.isNull(), "").when(listed, F.array_join(parts, "")).when(_kind(c) == "string", F.try_variant_get(c, "$", "string")).otherwise(F.to_json(c))


def _lookup(values: dict[str, str], c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def patch_touches(tool: Column, patch: Column) -> Column:
    """The files that an apply_patch call names, in order."""
    lines = F.filter(F.split(patch, "\n"), lambda x: x.rlike(PATCH_HEADER))
    touched = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, PATCH_HEADER, 2)).alias("path"), _lookup(PATCH_ACTIONS, F.regexp_extract(x, PATCH_HEADER, 1)).alias("action")))
    return F.when(tool == "apply_patch", touched).otherwise(F.array().cast(TOUCHES))


def claude_code(lines: DataFrame, all_blocks: bool = False) -> DataFrame:
    """Lines of the first agent. Only a message's first block counts; ``all_blocks`` gives
    a row to each."""
    v = F.col("v")
    rows = computed(lines, v=F.try_parse_json("raw_line")).drop("raw_line")
    rows = computed(rows, type=_text(v, "$.type"), content_=_variant(v, "$.message.content"))
    # a type's name is only asked for where it is short: it walks the whole value
    rows = computed(rows, listed=F.try_variant_get("content_", "$", "array<variant>"))
    rows = computed(rows, shape=F.when(F.col("listed").isNotNull(), "array").otherwise(_kind(F.col("content_"))), blocks=F.coalesce("listed", F.array().cast("array<variant>"))).drop("listed")
    b = F.col("b")
    if all_blocks:
        rows = rows.select("*", F.posexplode_outer("blocks").alias("block_no", "b"))
    else:
        rows = computed(rows, b=F.try_element_at("blocks", F.lit(1)))
    rows = computed(rows, block=_text(b, "$.type"))
    spoken = F.col("type").isin("user", "assistant")
    role = _text(v, "$.message.role")
    known = F.col("block").isin("text", "thinking", "tool_use", "tool_result")
    missing = spoken & F.col("content_").isNull() & (_kind(_variant(v, "$.message")) != "object")
    status = (
        F.when(v.isNull() | (F.col("type").isNull() & ~F.schema_of_variant(v).startswith("OBJECT")), "error")
        .when(missing | (spoken & ~F.col("shape").isin("string", "array")), "error")
        .when(spoken & ((F.col("shape") == "string") | known), "message")
        .when(F.col("type") == "system", "message")
        .when(F.col("type") == "ai-title", "session")
        .otherwise("skip")
    )
    error = F.when(status == "error", F.when(v.isNull(), "invalid JSON").when(missing, "line without a message").otherwise("message.content is neither a string nor an array"))
    kind = F.when(F.col("type") == "system", "event").when(F.col("shape") == "string", "text").otherwise(_lookup({"text": "text", "thinking": "thinking", "tool_use": "tool_call", "tool_result": "tool_result"}, F.col("block")))
    # each step is a column of its own, so that what later steps name is computed once
    rows = computed(rows, role_=role, kind_=kind, status_=status, error_=error)
    role, kind, status, error = (F.col(c) for c in ("role_", "kind_", "status_", "error_"))
    said = F.when(F.col("shape") == "string", F.try_variant_get("content_", "$", "string")).otherwise(F.coalesce(_text(b, "$.text"), F.lit("")))
    content = (
        F.when(F.col("type") == "system", F.coalesce(_text(v, "$.content"), F.lit("")))
        .when(kind == "text", F.when(role == "user", T.let(said, T.clean_pasted)).otherwise(said))
        .when(kind == "thinking", F.coalesce(_text(b, "$.thinking"), F.lit("")))
        .when(kind == "tool_call", F.coalesce(F.to_json(_variant(b, "$.input")), F.lit("")))
        .otherwise(_typed_parts(_variant(b, "$.content")))
    )
    rows = computed(rows, name_=_text(b, "$.name"), path_=F.nullif(_text(b, "$.input.file_path"), F.lit("")), content_text=content)
    content, path = F.col("content_text"), F.col("path_")
    action = _lookup(TOUCH_ACTIONS, F.col("name_"))
    touches = F.when((kind == "tool_call") & action.isNotNull() & path.isNotNull(), F.array(F.struct(path.alias("path"), action.alias("action")))).otherwise(F.array().cast(TOUCHES))
    made = status == "message"
    return rows.select(
        "line_id", "source_id", "agent", "line_no", status.alias("status"),
        *[F.when(status.isin("message", "session"), _text(v, p)).alias(n) for n, p in (("native_id", "$.sessionId"), ("cwd", "$.cwd"), ("git_branch", "$.gitBranch"), ("version", "$.version"))],
        F.when(made & spoken, _text(v, "$.message.model")).alias("model"), F.when(status == "session", _text(v, "$.aiTitle")).alias("title"),
        F.when(made, F.when(F.col("type") == "system", "system").when(kind == "tool_result", "tool").otherwise(role)).alias("role"), F.when(made, kind).alias("kind"),
        F.when(made & (kind == "tool_call"), F.col("name_")).alias("tool_name"),
        F.when(made & (kind == "tool_call"), _text(b, "$.id")).when(made & (kind == "tool_result"), _text(b, "$.tool_use_id")).alias("tool_use_id"),
        F.when(made, content).alias("content"), F.when(status.isin("message", "session"), _text(v, "$.timestamp")).alias("created_at"), F.when(made, touches).otherwise(F.array().cast(TOUCHES)).alias("touches"), error.alias("error"),
    )


def codex(lines: DataFrame) -> DataFrame:
    """Lines of the second agent, whose session id and directory hold from the line that
    names them to the end of the file."""
    v = F.col("v")
    meta = F.col("type") == "session_meta"
    rows = computed(lines, v=F.try_parse_json("raw_line")).drop("raw_line")
    rows = computed(rows, type=_text(v, "$.type"), p=_text(v, "$.payload.type"), content_=_variant(v, "$.payload.content"))
    rows = computed(rows, native_id=F.when(meta, _text(v, "$.payload.session_id")), cwd=F.when(meta, F.coalesce(_text(v, "$.payload.cwd"), F.lit(""))).when(F.col("type") == "turn_context", F.nullif(_text(v, "$.payload.cwd"), F.lit(""))))
    rows = carry_forward(rows, ["source_id"], "line_no", ["native_id", "cwd"], ("line_id",))
    rows = computed(rows, kinds_=F.try_variant_get(v, "$.payload.internal_chat_message_metadata_passthrough.content_item_kinds[0]", "string"), listed_=F.try_variant_get("content_", "$", "array<variant>"), parts_=_blocks(F.col("content_")), failed_=F.nullif(_text(v, "$.payload.error.message"), F.lit("")), input_=_text(v, "$.payload.input"), name_=_text(v, "$.payload.name"))
    item, kinds = F.col("type") == "response_item", F.col("kinds_")
    first = _text(F.try_element_at("parts_", F.lit(1)), "$.text")
    summary = _variant(v, "$.payload.summary")
    failed = F.col("failed_")
    said = item & (F.col("p") == "message")
    bad = said & F.col("listed_").isNull()
    status = (
        F.when(v.isNull() | (F.col("type").isNull() & ~F.schema_of_variant(v).startswith("OBJECT")) | bad, "error")
        .when(said & (F.size("parts_") > 0), "message")
        .when(item & F.col("p").isin("custom_tool_call", "custom_tool_call_output"), "message")
        .when(item & (F.col("p") == "reasoning") & (F.size(_blocks(summary)) > 0), "message")
        .when((F.col("type") == "event_msg") & (F.col("p") == "task_complete") & failed.isNotNull(), "message")
        .when(F.col("type").isin("session_meta", "turn_context"), "session")
        .otherwise("skip")
    )
    raw_role = _text(v, "$.payload.role")
    who = F.when(raw_role == "assistant", "assistant").when(kinds.isNull(), F.when(raw_role == "developer", "system").otherwise("user")).when(kinds == "user.text", "user").otherwise("system")
    role = F.when(said, who).when(F.col("p") == "custom_tool_call_output", "tool").when(F.col("type") == "event_msg", "system").otherwise("assistant")
    kind = F.when(said, F.when(who == "system", "event").otherwise("text")).when(F.col("p") == "custom_tool_call", "tool_call").when(F.col("p") == "custom_tool_call_output", "tool_result").when(F.col("type") == "event_msg", "event").otherwise("thinking")
    rows = computed(rows, role_=role, kind_=kind, status_=status, said_=said, meta_=meta)
    role, kind, status, said, meta = (F.col(c) for c in ("role_", "kind_", "status_", "said_", "meta_"))
    content = (
        F.when(said, F.when(role == "user", T.let(F.coalesce(first, F.lit("")), T.clean_escaped)).otherwise(F.coalesce(first, F.lit(""))))
        .when(kind == "tool_call", F.coalesce("input_", F.lit("")))
        .when(kind == "tool_result", _all_parts(_variant(v, "$.payload.output")))
        .when(kind == "event", failed)
        .otherwise(_all_parts(summary))
    )
    made, told = status == "message", status.isin("message", "session")
    tool = F.when(made & (kind == "tool_call"), F.col("name_"))
    touches = F.when(made & (kind == "tool_call"), patch_touches(F.col("name_"), F.coalesce("input_", F.lit("")))).otherwise(F.array().cast(TOUCHES))
    none = F.lit(None).cast("string")
    return rows.select(
        "line_id", "source_id", "agent", "line_no", status.alias("status"), F.when(told, F.col("native_id")).alias("native_id"), F.when(told, F.col("cwd")).alias("cwd"), none.alias("git_branch"),
        F.when(meta & told, _text(v, "$.payload.cli_version")).alias("version"), F.when((F.col("type") == "turn_context") & told, _text(v, "$.payload.model")).alias("model"), none.alias("title"),
        F.when(made, role).alias("role"), F.when(made, kind).alias("kind"), tool.alias("tool_name"), F.when(made & kind.isin("tool_call", "tool_result"), _text(v, "$.payload.call_id")).alias("tool_use_id"),
        F.when(made, content).alias("content"), F.when(told, _text(v, "$.timestamp")).alias("created_at"), touches.alias("touches"), F.when(status == "error", F.when(v.isNull(), "invalid JSON").otherwise("message.content is no array")).alias("error"),
    )


#: Adapters by agent; a new agent's is added here.
ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"claude-code": claude_code, "codex": codex}


def parse(lines: DataFrame) -> DataFrame:
    """All agents' lines; blank lines have no row, unknown agents' lines neither."""
    rows = lines.where(F.trim("raw_line") != "").select("line_id", "source_id", "agent", "line_no", "raw_line")
    parts = [f(rows.where(F.col("agent") == a)) for a, f in ADAPTERS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ingest_report(parsed: DataFrame) -> DataFrame:
    """(source_id, messages, skipped, failed, last_error) of each file that was read."""
    of = lambda s: F.count_if(F.col("status") == s)
    return parsed.groupBy("source_id").agg(of("message").alias("messages"), F.count_if(F.col("status").isin("skip", "session")).alias("skipped"), of("error").alias("failed"), F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("line_no", "line_id"))).alias("last_error"))
