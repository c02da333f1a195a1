"""Continuous ingest: a tail stream, idempotent micro-batches, replayable tables.

Every batch parses its own lines only. What a file's earlier lines say about later ones (a
session's id, its directory) is read from the rows that were parsed before. A batch writes
its parsed rows, the sessions that it touches, and these sessions' messages and chunks, to
folders named after the batch; a batch that is run again overwrites its own folders, so
each line counts once however often a batch is retried.

What is current is a query: of a file the rows since it was last begun from offset 0 (a
rewritten file replaces its rows), of a session the messages of the last batch that
touched it. A session may go on in any number of files: its messages are numbered anew
from all of its rows, which stand in one of ``BUCKETS`` folders by its id, so a batch reads
the folders of its sessions and no others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import transcript
from strandline.session import cut
from strandline.sources import adapters, jsonl

BUCKETS = 64
PARSED = "line_id long, log_path string, source_id long, agent string, line_no long, status string, native_id string, cwd string, git_branch string, version string, model string, title string, role string, kind string, tool_name string, tool_use_id string, content string, created_at string, touches array<struct<path:string,action:string>>, error string, batch long, bucket int"
MESSAGES = "message_id long, session_id string, seq long, role string, kind string, tool_name string, tool_use_id string, content string, created_at string, batch long"
CHUNKS = "session_id string, first_seq long, last_seq long, chunk_text string, batch long"
SOURCES = "log_path string, source_id long, agent string, begun boolean, batch long"
TOUCHED = "session_id string, batch long"


class LogStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str, schema: str) -> DataFrame:
        # the folders of batches are written whole; none yet means an empty table
        if not jsonl.exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def sources(self) -> DataFrame:
        """(log_path, source_id, agent, begun): of each file its number and the last batch that
        began it from its first line."""
        rows = self.read("sources", SOURCES)
        return rows.groupBy("log_path").agg(F.min("source_id").alias("source_id"), F.min("agent").alias("agent"), F.max(F.when(F.col("begun"), F.col("batch"))).alias("begun"))

    def parsed(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows that count, of some buckets or all."""
        rows = self.read("parsed", PARSED)
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(buckets))
        begun = self.sources().select(F.col("log_path").alias("_p"), F.col("begun").alias("_begun"))
        return rows.join(begun.hint("merge"), F.col("log_path") == F.col("_p"), "left").where(F.col("_begun").isNull() | (F.col("batch") >= F.col("_begun"))).drop("_p", "_begun")

    def _last(self, name: str, schema: str) -> DataFrame:
        last = self.read("touched", TOUCHED).groupBy(F.col("session_id").alias("_s")).agg(F.max("batch").alias("_b"))
        return self.read(name, schema).join(last.hint("merge"), (F.col("session_id") == F.col("_s")) & (F.col("batch") == F.col("_b"))).drop("_s", "_b", "batch")

    def messages(self) -> DataFrame:
        return self._last("messages", MESSAGES)

    def chunks(self) -> DataFrame:
        return self._last("chunks", CHUNKS)

    def write(self, name: str, df: DataFrame, batch: int, by: str | None = None) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by else w).parquet(f"{self.path}/{name}/batch={batch}")


def agent_of(path: str) -> str:
    return "codex" if "codex" in path else "claude-code"


def bucket_of(native_id: str = "native_id"):
    return F.pmod(F.xxhash64("agent", native_id), F.lit(BUCKETS)).cast("int")


def _number_files(store: LogStore, batch: DataFrame, batch_id: int, agent: Callable[[str], str]) -> DataFrame:
    """(log_path, source_id, agent, begun) of the batch's files; new ones are numbered after
    those of earlier batches, in the order of their paths."""
    old = store.read("sources", SOURCES).where(F.col("batch") < batch_id)
    base = old.agg(F.coalesce(F.max("source_id"), F.lit(0))).first()[0]
    known = old.groupBy("log_path").agg(F.min("source_id").alias("source_id"))
    files = batch.groupBy("log_path").agg((F.min("byte_offset") == 0).alias("begun")).join(known.hint("merge"), "log_path", "left")
    name = F.udf(agent, "string")  # a row for each file
    new = files.where("source_id is null").withColumn("source_id", (F.row_number().over(Window.orderBy("log_path")) + F.lit(base)).cast("long"))  # a batch's new files
    both = files.where("source_id is not null").unionByName(new)
    return both.select("log_path", "source_id", name("log_path").alias("agent"), "begun")


def handle_batch(store: LogStore, batch: DataFrame, batch_id: int, agent: Callable[[str], str] = agent_of) -> None:
    """One micro-batch: see the module."""
    if batch.isEmpty():
        return
    batch = batch.select("log_path", "byte_offset", "raw_line")
    store.write("sources", _number_files(store, batch, batch_id, agent), batch_id)
    files = store.read("sources", SOURCES).where(F.col("batch") == batch_id).drop("batch")
    lines = batch.join(files.drop("begun"), "log_path").select(F.xxhash64("log_path", "byte_offset").alias("line_id"), "source_id", "agent", F.col("byte_offset").alias("line_no"), "raw_line")
    # what earlier lines of these files said, where the batch goes on in them
    before = store.parsed().where(F.col("batch") < batch_id)
    goes_on = files.where("not begun and agent = 'codex'").select("source_id")
    at = F.struct("line_no", "line_id")
    said = before.join(goes_on, "source_id", "left_semi").groupBy(F.col("source_id").alias("_f")).agg(F.max_by("native_id", F.when(F.col("native_id").isNotNull(), at)).alias("_sid"), F.max_by("cwd", F.when(F.col("cwd").isNotNull(), at)).alias("_cwd"))
    told = F.col("status").isin("message", "session")
    rows = adapters.parse(lines).join(said, F.col("source_id") == F.col("_f"), "left")
    rows = rows.withColumn("native_id", F.when(told, F.coalesce("native_id", "_sid")).otherwise(F.col("native_id"))).withColumn("cwd", F.when(told, F.coalesce("cwd", "_cwd")).otherwise(F.col("cwd"))).drop("_f", "_sid", "_cwd")
    rows = rows.join(files.select("source_id", "log_path"), "source_id").withColumn("bucket", bucket_of())
    store.write("parsed", rows, batch_id, by="bucket")
    # the sessions of the batch, and those that a rewritten file may have lost
    session = transcript.session_key()
    mine = store.read("parsed", PARSED).where(F.col("batch") == batch_id)
    lost = store.read("parsed", PARSED).where(F.col("batch") < batch_id).join(files.where("begun").select("source_id"), "source_id", "left_semi")
    of = [x.where("native_id is not null").select(session.alias("session_id"), "bucket").distinct() for x in (mine, lost)]
    touched = cut(of[0].unionByName(of[1]).distinct())
    store.write("touched", touched.select("session_id"), batch_id)
    buckets = [r.bucket for r in touched.select("bucket").distinct().collect()]  # BUCKETS at most
    whole = store.parsed(buckets).join(touched.select("session_id"), session == F.col("session_id"), "left_semi")
    store.write("messages", transcript.messages(whole).drop("touches", "source_id", "line_no"), batch_id)
    written = store.read("messages", MESSAGES).where(F.col("batch") == batch_id)
    store.write("chunks", transcript.chunks(written), batch_id)


def report(store: LogStore) -> DataFrame:
    """(log_path, messages, skipped, failed, last_error) of every file."""
    counts = adapters.ingest_report(store.parsed())
    return counts.join(store.sources().select("source_id", "log_path"), "source_id").drop("source_id")


def follow(spark: SparkSession, root: str, store: LogStore, checkpoint: str, once: bool = False, interval: str = "500 milliseconds"):
    """Starts the stream; the first batch is the catch-up scan, and each trigger lists the
    folder again. ``once`` drains what is there and ends."""
    jsonl.register(spark)
    lines = spark.readStream.format("jsonl_tail").load(root)
    writer = lines.writeStream.foreachBatch(lambda df, i: handle_batch(store, df, i)).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=interval).start() if not once else writer.trigger(availableNow=True).start()
