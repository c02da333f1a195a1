"""Changes of a store on immutable files: every operator gives the new table."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.schemas import NOTE_KINDS, TABLES, conform
from strandline.session import cut
from strandline.sources.adapters import patch_touches

from . import fulltext


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def insert_new(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with those of ``rows`` whose key it lacks; of repeated new keys one counts."""
    new = rows.dropDuplicates(key).join(table.select(*key), key, "left_anti")
    return table.unionByName(new.select(*table.columns))


def replace_groups(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with all rows of the groups in ``rows`` replaced by these."""
    return table.join(rows.select(key).distinct(), key, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def upsert_sessions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions merged: what a session said last counts where it isn't empty; the project,
    the beginning and the first commit stay, the greatest end and the worst trust win."""
    from .transcript import TRUST

    a, b = conform(old, "sessions"), _renamed(conform(new, "sessions"), "n_")
    both = a.join(b, F.col("session_id") == F.col("n_session_id"), "full")

    def filled(c: str, first: str, second: str) -> Column:
        return F.coalesce(F.nullif(F.col(first), F.lit("")), F.nullif(F.col(second), F.lit(""))).alias(c)

    rank = F.array(*map(F.lit, TRUST))
    ours, theirs = F.coalesce(F.array_position(rank, F.col("commit_source")), F.lit(0)), F.coalesce(F.array_position(rank, F.col("n_commit_source")), F.lit(0))
    rules = {c: filled(c, "n_" + c, c) for c in ("cwd", "git_branch", "ending_commit", "model", "title", "summary")}
    rules |= {c: filled(c, c, "n_" + c) for c in ("starting_commit", "started_at")}
    rules["ended_at"] = F.greatest("ended_at", "n_ended_at").alias("ended_at")
    rules["commit_source"] = F.when(theirs > ours, F.col("n_commit_source")).otherwise(F.col("commit_source")).alias("commit_source")
    rules["message_count"] = (F.coalesce("message_count", F.lit(0)) + F.coalesce("n_message_count", F.lit(0))).cast("long").alias("message_count")
    return both.select(*[rules.get(c, F.coalesce(F.col(c), F.col("n_" + c)).alias(c)) for c in a.columns])


def delete_cascade(tables: dict[str, DataFrame], name: str, keys: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of ``name`` whose key is in ``keys``, and without, or
    with nulls in, what hangs on them."""
    key = TABLES[name].key[0]
    out = dict(tables)
    gone = tables[name].join(keys.select(key), key, "left_semi")
    out[name] = tables[name].join(keys.select(key), key, "left_anti").select(*tables[name].columns)
    for child, spec in TABLES.items():
        for column, (parent, parent_key, rule) in spec.parents.items():
            if parent != name or child not in out:
                continue
            dead = gone.select(F.col(parent_key).alias("_dead")).distinct()
            rows, columns = out[child], out[child].columns
            if rule == "cascade":
                doomed = rows.join(dead, F.col(column) == F.col("_dead"), "left_semi").select(TABLES[child].key[0])
                out |= delete_cascade(out, child, doomed)
            else:
                out[child] = rows.join(dead, F.col(column) == F.col("_dead"), "left").withColumn(column, F.when(F.col("_dead").isNull(), F.col(column))).select(*columns)
    return out


def recount(session_rows: DataFrame, msgs: DataFrame) -> DataFrame:
    """Sessions with their true message_count."""
    n = msgs.groupBy("session_id").agg(F.count(F.lit(1)).alias("_n"))
    return session_rows.join(n, "session_id", "left").withColumn("message_count", F.coalesce("_n", F.lit(0).cast("long"))).select(*session_rows.columns)


def merge_projects(tables: dict[str, DataFrame], source: int, into: int) -> dict[str, DataFrame]:
    """One project's rows handed to another. Its vectors are dropped and its chunks wait to
    be embedded again; a remote is inherited. Raises if it can't be."""
    p = {r.project_id: r.git_remote for r in tables["projects"].where(F.col("project_id").isin(source, into)).select("project_id", "git_remote").collect()}
    if source == into or len(p) != 2:
        raise ValueError("two different projects are needed")
    if p[source] and p[into]:
        raise ValueError("both projects have a remote")
    moved = F.when(F.col("project_id") == source, F.lit(into)).otherwise(F.col("project_id"))
    out = {n: df.withColumn("project_id", moved) if n in ("sessions", "file_touches", "notes", "project_paths") else df for n, df in tables.items()}
    out["projects"] = tables["projects"].where(F.col("project_id") != source).withColumn("git_remote", F.when(F.col("project_id") == into, F.lit(p[into] or p[source])).otherwise(F.col("git_remote")))
    ours = tables["sessions"].where(F.col("project_id") == source).select(F.col("session_id").alias("_s"))
    if "chunk_vectors" in tables:
        out["chunk_vectors"] = tables["chunk_vectors"].where(F.col("project_id").isNull() | (F.col("project_id") != source))
    if "chunks" in tables:
        c = tables["chunks"].join(ours, F.col("session_id") == F.col("_s"), "left")
        stale = F.col("_s").isNotNull()
        out["chunks"] = c.withColumn("embedded_at", F.when(~stale, F.col("embedded_at"))).withColumn("embedding_model", F.when(~stale, F.col("embedding_model"))).drop("_s")
    return out


def find_or_create_projects(homes: DataFrame, projects: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(homes with project_id, projects, paths). ``homes``: cwd, git_remote.

    The longest known path counts, then the remote, else a new project named after the
    directory, one for each remote or directory, numbered in order after the greatest id.
    """
    from .ordered import longest_prefix

    cols = homes.columns
    known = longest_prefix(homes.dropDuplicates(["cwd"]), "cwd", paths, "path", "project_id").withColumn("remote", T.normalise_remote("git_remote"))
    r = projects.where("git_remote is not null").select(F.col("git_remote").alias("_remote"), F.col("project_id").alias("_by_remote"))
    known = known.join(r, F.col("remote") == F.col("_remote"), "left").withColumn("project_id", F.coalesce("project_id", "_by_remote")).drop("_remote", "_by_remote")
    new = known.where("project_id is null and cwd is not null").withColumn("_id", F.coalesce("remote", "cwd")).groupBy("_id").agg(F.min("cwd").alias("path"), F.first("remote").alias("git_remote"))
    base = projects.agg(F.coalesce(F.max("project_id"), F.lit(0))).scalar()
    from pyspark.sql import Window

    # numbered without a window over all of them: ranges of _id, and before each the rows of those before
    ranged = cut(new.repartitionByRange("_id").sortWithinPartitions("_id").withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))  # a row for each partition
    before = sizes.select(F.col("_part").alias("_p"), (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    numbered = ranged.join(F.broadcast(before), F.col("_part") == F.col("_p")).withColumn("project_id", (F.col("_n") + F.col("_before") + 1 + base).cast("long"))
    made = numbered.select("project_id", F.regexp_extract("path", r"([^/]*)/*$", 1).alias("project_name"), "git_remote", F.lit(None).cast("string").alias("created_at"))
    n = numbered.select(F.col("_id").alias("_n"), F.col("project_id").alias("_new"))
    of = known.withColumn("_id", F.coalesce("remote", "cwd")).join(n, F.col("_id") == F.col("_n"), "left").select("cwd", F.coalesce("project_id", "_new").alias("project_id"))
    out = homes.join(of, "cwd", "left").select(*cols, "project_id")
    more = of.where("cwd is not null and project_id is not null").select(F.col("cwd").alias("path"), "project_id", F.lit(None).cast("string").alias("first_seen"))
    return out, conform(projects, "projects").unionByName(conform(made, "projects")), insert_new(conform(paths, "project_paths"), conform(more, "project_paths"), ["path"])


def add_note(spark: SparkSession, notes: DataFrame, kind: str, title: str, body: str = "", tags: list[str] | None = None, project_id: int | None = None, agent: str = "unknown", now: str = "") -> DataFrame:
    """Notes with one more; its kind is checked, its title needed, its text redacted."""
    if kind not in NOTE_KINDS:
        raise ValueError(f"kind must be one of {', '.join(NOTE_KINDS)}")
    if not title.strip():
        raise ValueError("a note needs a title")
    row = spark.createDataFrame([(project_id, None, agent or "unknown", kind, title, body, json.dumps(tags or []), None, now)], "project_id long, session_id string, agent string, kind string, title string, body string, tags string, superseded_by long, created_at string")
    number = notes.agg(F.coalesce(F.max("note_id"), F.lit(0)) + 1).scalar()
    row = row.withColumn("note_id", number.cast("long")).withColumn("title", T.redact("title")).withColumn("body", T.redact("body"))
    return conform(notes, "notes").unionByName(conform(row, "notes"))


def supersede(notes: DataFrame, old: int, new: int) -> DataFrame:
    return notes.withColumn("superseded_by", F.when(F.col("note_id") == old, F.lit(new).cast("long")).otherwise(F.col("superseded_by")))


def note_texts(notes: DataFrame) -> DataFrame:
    """(note_id, text): what of a note is searched."""
    return notes.select("note_id", F.concat_ws("\n", "title", "body").alias("text"))


def search_notes(notes: DataFrame, query: str, project_id: int | None = None, limit: int = 10, index: fulltext.Index | None = None) -> DataFrame:
    """Live notes of a project and global ones, both columns searched as one text, by the
    ``index`` of ``note_texts`` or else by a scan; tags decoded, an empty list if they are
    no JSON array."""
    live = notes.where(F.col("superseded_by").isNull() & (F.col("project_id").isNull() | (F.col("project_id") == F.lit(project_id))))
    found = index.search(query, "note_id") if index else fulltext.search(note_texts(notes), query, "note_id", "text")
    hits = found.join(live, "note_id")
    tags = F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>"))
    return hits.orderBy("bm25", "note_id").limit(limit if limit > 0 else 10).select("note_id", "kind", "title", "body", tags.alias("tags"), "agent", "created_at", "bm25")


def pending_chunks(chunk_rows: DataFrame, session_rows: DataFrame, vectors: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Chunks that wait for a vector, of sessions with a project, in order of id. With
    ``vectors``, those that have none there; else those without ``embedded_at``."""
    s = session_rows.where("project_id is not null").select("session_id", "project_id", "agent")
    wait = chunk_rows.join(vectors.select("chunk_id"), "chunk_id", "left_anti") if vectors is not None else chunk_rows.where("embedded_at is null")
    out = wait.join(s, "session_id").select("chunk_id", "chunk_text", "project_id", "agent", "session_id").orderBy("chunk_id")
    return out.limit(limit) if limit is not None else out


def write_vectors(tables: dict[str, DataFrame], vectors: DataFrame, model: str, now: Column | None = None) -> dict[str, DataFrame]:
    """chunks and chunk_vectors after an embedding step: the vectors are added where a chunk
    has none, and those chunks are marked. Waiting is decided by the vectors alone, so a
    crash between the two writes only leaves a mark to be set by the next step."""
    at = now if now is not None else T.utc_now()
    known = insert_new(tables["chunk_vectors"], vectors.where("embedding is not null").select(*tables["chunk_vectors"].columns), ["chunk_id"])
    done = known.select(F.col("chunk_id").alias("_c"))
    c = tables["chunks"].join(done, F.col("chunk_id") == F.col("_c"), "left")
    new = F.col("_c").isNotNull() & F.col("embedded_at").isNull()
    marked = c.withColumn("embedding_model", F.when(new, F.lit(model)).otherwise(F.col("embedding_model"))).withColumn("embedded_at", F.when(new, at.cast(tables["chunks"].schema["embedded_at"].dataType)).otherwise(F.col("embedded_at")))
    return tables | {"chunk_vectors": known, "chunks": marked.select(*tables["chunks"].columns)}


# -- repairs: the rows that change; counting them is the dry run ---------------------------------
def repair_commits(session_rows: DataFrame, msgs: DataFrame, history: DataFrame) -> DataFrame:
    """(session_id, starting_commit, ending_commit, commit_source) where they change.

    ``history``: cwd, at (seconds), hash, source. The commits at a session's first and last
    message are looked up; sessions without one keep theirs but become unverified.
    """
    from .ordered import asof

    span = session_rows.join(msgs.groupBy("session_id").agg(F.min("created_at").alias("_a"), F.max("created_at").alias("_z")), "session_id", "left")
    ends = span.select("session_id", "cwd", F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("_a").alias("t")), F.struct(F.lit(1).alias("end"), F.col("_z").alias("t")))).alias("e"))
    ends = ends.select("session_id", "cwd", "e.end", F.unix_seconds(F.try_to_timestamp(F.col("e.t"))).alias("at"))
    hit = asof(ends, history.withColumnRenamed("at", "commit_at"), ["cwd"], "at", "commit_at", ["hash", "source"])
    two = hit.groupBy("session_id").agg(F.max(F.when(F.col("end") == 0, F.col("hash"))).alias("a"), F.max(F.when(F.col("end") == 1, F.col("hash"))).alias("z"), F.max("source").alias("src"))
    both = session_rows.join(two, "session_id", "left")
    new_a, new_z = F.coalesce("a", "starting_commit"), F.coalesce("z", "ending_commit")
    src = F.when(F.col("z").isNull(), F.when(F.coalesce("starting_commit", "ending_commit").isNotNull(), F.lit("unverified"))).otherwise(F.col("src"))
    out = both.select("session_id", new_a.alias("starting_commit"), new_z.alias("ending_commit"), F.coalesce(src, F.col("commit_source")).alias("commit_source"), F.struct("starting_commit", "ending_commit", "commit_source").alias("_was"))
    now = F.struct("starting_commit", "ending_commit", "commit_source")
    return out.where(~now.eqNullSafe(F.col("_was"))).drop("_was")


def repair_paths(touches: DataFrame, roots: DataFrame) -> DataFrame:
    """(touch_id, path): touches that aren't rooted, seen from their session's repository.
    ``roots``: session_id, cwd, root; sessions without a root are left alone."""
    t = touches.where("not rooted").join(roots.where("root is not null"), "session_id")
    full = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat_ws("/", "cwd", "path"))
    return t.select("touch_id", T.relative_path(full, "root").alias("path"))


def repair_touches(msgs: DataFrame, touches: DataFrame) -> DataFrame:
    """(session_id, message_id, path, action): patches whose touches were never stored."""
    calls = msgs.where((F.col("tool_name") == "apply_patch") & (F.col("kind") == "tool_call")).join(touches.select("message_id").where("message_id is not null"), "message_id", "left_anti")
    return calls.select("session_id", "message_id", F.explode(patch_touches(F.col("tool_name"), F.col("content"))).alias("t")).select("session_id", "message_id", F.col("t.path").alias("path"), F.col("t.action").alias("action"))


def repair_counts(changes: dict[str, DataFrame]) -> DataFrame:
    """(repair, changed_rows) of repairs by name: all of a dry run, and what a real one reports."""
    out = None
    for name, rows in changes.items():
        one = rows.agg(F.count(F.lit(1)).alias("changed_rows")).select(F.lit(name).alias("repair"), "changed_rows")
        out = one if out is None else out.unionByName(one)
    return out


def apply_changes(table: DataFrame, changes: DataFrame, key: str, dry_run: bool = False) -> DataFrame:
    """``table`` with the columns of ``changes`` in the rows that it names; as it was, in a dry run."""
    if dry_run:
        return table
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    both = table.join(new, F.col(key) == F.col("_key"), "left")
    return both.select(*[F.when(F.col("_key").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in changes.columns and c != key else F.col(c) for c in table.columns])


def project_list(projects: DataFrame, session_rows: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    n = session_rows.groupBy(F.col("project_id").alias("_p")).agg(F.count(F.lit(1)).alias("sessions"))
    out = projects.join(n, F.col("project_id") == F.col("_p"), "left").drop("_p")
    joined = F.lit("")
    if paths is not None:
        out = out.join(paths.groupBy(F.col("project_id").alias("_q")).agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("paths")), F.col("project_id") == F.col("_q"), "left").drop("_q")
        joined = F.coalesce("paths", F.lit(""))
    return out.select("project_id", "project_name", F.coalesce("git_remote", F.lit("-")).alias("git_remote"), F.coalesce("sessions", F.lit(0).cast("long")).alias("sessions"), joined.alias("paths"))
