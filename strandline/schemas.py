"""The tables of a store, their keys and rules; verified rather than enforced."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

L, S, B = T.LongType(), T.StringType(), T.BooleanType()


@dataclass(frozen=True)
class Table:
    columns: dict[str, T.DataType]
    key: tuple[str, ...]
    unique: tuple[tuple[str, ...], ...] = ()
    required: tuple[str, ...] = ()
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)
    json: tuple[str, ...] = ()
    #: column -> (table, column, what becomes of the row when its parent is deleted)
    parents: dict[str, tuple[str, str, str]] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(k, v, k not in self.required) for k, v in self.columns.items()])


# --- fixed values: the enumerations of the data model --------------------------------------------
ROLES = ("user", "assistant", "system", "tool")
KINDS = ("text", "tool_call", "tool_result", "thinking", "event")
ACTIONS = ("read", "edit", "create", "delete", "rename")
NOTE_KINDS = ("decision", "gotcha", "convention", "todo", "fact")
# ---------------------------------------------------------------------------------------------------
TABLES: dict[str, Table] = {
    "projects": Table({"project_id": L, "project_name": S, "git_remote": S, "created_at": S}, ("project_id",), (("git_remote",),), ("project_id", "project_name")),
    "project_paths": Table({"path": S, "project_id": L, "first_seen": S}, ("path",), (), ("path", "project_id"), parents={"project_id": ("projects", "project_id", "cascade")}),
    "sources": Table({"source_id": L, "agent": S, "log_path": S, "byte_offset": L, "content_head_hash": S, "last_ingested_at": S, "last_error": S}, ("source_id",), (("log_path",),), ("source_id", "log_path")),
    "sessions": Table({"session_id": S, "agent": S, "native_id": S, "project_id": L, "source_id": L, "parent_session_id": S, "cwd": S, "git_branch": S, "starting_commit": S, "ending_commit": S, "commit_source": S, "model": S, "title": S, "summary": S, "started_at": S, "ended_at": S, "message_count": L, "meta": S}, ("session_id",), (("agent", "native_id"),), ("session_id", "agent", "native_id"), json=("meta",), parents={"project_id": ("projects", "project_id", "null")}),
    "messages": Table({"message_id": L, "session_id": S, "seq": L, "role": S, "kind": S, "tool_name": S, "content": S, "created_at": S, "raw": S}, ("message_id",), (("session_id", "seq"),), ("session_id", "seq", "role", "kind"), {"role": ROLES, "kind": KINDS}, ("raw",), {"session_id": ("sessions", "session_id", "cascade")}),
    "chunks": Table({"chunk_id": L, "session_id": S, "first_seq": L, "last_seq": L, "chunk_text": S, "embedded_at": S, "embedding_model": S}, ("chunk_id",), (("session_id", "first_seq"),), ("session_id", "first_seq", "last_seq"), parents={"session_id": ("sessions", "session_id", "cascade")}),
    "chunk_vectors": Table({"chunk_id": L, "project_id": L, "agent": S, "embedding": T.ArrayType(T.FloatType()), "session_id": S}, ("chunk_id",), (), ("chunk_id", "embedding"), parents={"chunk_id": ("chunks", "chunk_id", "cascade")}),
    "file_touches": Table({"touch_id": L, "session_id": S, "message_id": L, "project_id": L, "path": S, "action": S, "created_at": S, "rooted": B}, ("touch_id",), (), ("session_id", "path", "action"), {"action": ACTIONS}, (), {"session_id": ("sessions", "session_id", "cascade"), "message_id": ("messages", "message_id", "cascade"), "project_id": ("projects", "project_id", "cascade")}),
    "notes": Table({"note_id": L, "project_id": L, "session_id": S, "agent": S, "kind": S, "title": S, "body": S, "tags": S, "superseded_by": L, "created_at": S}, ("note_id",), (), ("note_id", "kind", "title"), {"kind": NOTE_KINDS}, ("tags",), {"project_id": ("projects", "project_id", "cascade"), "session_id": ("sessions", "session_id", "null")}),
}


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the columns of a table: missing ones as null, in order and cast."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in TABLES[name].columns.items()])


def describe(spark: SparkSession) -> DataFrame:
    """(table_name, column_name, position, kind, required, key) of every column of the store."""
    rows = [(n, c, i, k.simpleString(), c in t.required, c in t.key) for n, t in TABLES.items() for i, (c, k) in enumerate(t.columns.items())]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int, kind string, required boolean, key boolean")


def missing_columns(df: DataFrame, name: str) -> list[str]:
    """Columns of a table that ``df`` lacks."""
    return [c for c in TABLES[name].columns if c not in df.columns]


#: Steps that bring an older store up to date: (version, table, change); a step adds columns
#: or changes rows, and runs once, in order.
Migration = tuple[int, str, Callable[[DataFrame], DataFrame]]


def migrate(spark: SparkSession, path: str, steps: list[Migration]) -> int:
    """Runs the steps above the store's version, each into a folder of its own, and notes
    every version when its table is whole; the version that is reached. A run that broke
    off goes on where it stood: a table's latest folder is what ``versions`` names."""
    fs = spark._jvm.org.apache.hadoop.fs
    root = fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    mark = f"{path}/versions"
    done = {r.version: r.table_name for r in spark.read.schema("version int, table_name string").json(mark).collect()} if system.exists(fs.Path(mark)) else {}
    for version, name, change in sorted(steps, key=lambda s: s[0]):
        if version in done:
            continue
        old = max((v for v, t in done.items() if t == name), default=0)
        folder = f"{path}/{name}/v={old}"
        rows = spark.read.parquet(folder) if system.exists(fs.Path(folder)) else spark.createDataFrame([], TABLES[name].schema)
        change(rows).write.mode("overwrite").parquet(f"{path}/{name}/v={version}")
        spark.createDataFrame([(version, name)], "version int, table_name string").coalesce(1).write.mode("append").json(mark)
        done[version] = name
    return max(done, default=0)


def open_folder(spark: SparkSession, path: str) -> str:
    """A store's folder, made if it isn't there, for its owner alone."""
    fs = spark._jvm.org.apache.hadoop.fs
    folder = fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(folder)
    system.setPermission(folder, fs.permission.FsPermission("700"))
    return path


def violations(df: DataFrame, name: str) -> DataFrame:
    """(rule, violations): how many rows break each rule of a table; one aggregation for
    the row rules, one for each key."""
    t, checks = TABLES[name], {}
    for c in t.required:
        checks[f"{c} is null"] = F.col(c).isNull()
    for c, values in t.allowed.items():
        checks[f"{c} is not allowed"] = F.col(c).isNotNull() & ~F.col(c).isin(*values)
    for c in t.json:
        checks[f"{c} is no JSON"] = F.col(c).isNotNull() & F.try_parse_json(c).isNull()
    if "first_seq" in t.columns:
        checks["last_seq is before first_seq"] = F.col("last_seq") < F.col("first_seq")
    rows = df.agg(*[F.count_if(cond).alias(f"c{i}") for i, cond in enumerate(checks.values())]) if checks else None
    out = None
    if rows is not None:
        out = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"c{i}").alias("violations")) for i, k in enumerate(checks)])).alias("x")).select("x.*")
    for key in (t.key, *t.unique):
        whole = df.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
        one = whole.select(F.lit("repeated " + ", ".join(key)).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out
