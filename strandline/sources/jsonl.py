"""Log files: a batch scan, a tail source that keeps byte offsets, rewrite detection.

Folders may be local or any that Hadoop (the scan) or Arrow (the tail source: hdfs, s3, gs
...) reads by its address. A large file is read in spans of ``SPAN`` bytes, each by a task
of its own: a span's lines are those that begin in it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

HEAD_BYTES = 4096
SPAN = 64 << 20
SCHEMA = "log_path string, byte_offset long, raw_line string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(log_path, raw_line) of every line of every *.jsonl below a folder; a folder that
    isn't there has none. Order within a file is the tail source's business."""
    if not exists(spark, root):
        return spark.createDataFrame([], "log_path string, raw_line string")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").text(root)
    return lines.select(F.col("_metadata.file_path").alias("log_path"), F.col("value").alias("raw_line")).where(F.trim("raw_line") != "")


# -- files by address ------------------------------------------------------------------------
def _system(path: str):
    """(file system, path in it, what stands before that in an address)."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def _open(path: str):
    system, inner, _ = _system(path)
    return system.open_input_file(inner)


def size_of(path: str) -> int:
    system, inner, _ = _system(path)
    return system.get_file_info(inner).size or 0


def _files(root: str) -> list[tuple[str, int, object]]:
    """(path, size, time of change) of the log files below a folder."""
    from pyarrow import fs

    system, inner, before = _system(root)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=True))
    return sorted((before + f.path, f.size, f.mtime_ns) for f in found if f.is_file and f.path.endswith(".jsonl"))


def head_hash(path: str, upto: int) -> str:
    """Of the first bytes that were read, 4096 at most."""
    with _open(path) as f:
        return hashlib.sha256(f.read(min(HEAD_BYTES, upto))).hexdigest()


def rewritten(path: str, offset: int, seen_hash: str | None) -> bool:
    """Whether a file isn't the one that was read up to ``offset``."""
    return offset > 0 and (size_of(path) < offset or (seen_hash is not None and head_hash(path, offset) != seen_hash))


def complete_lines(path: str, start: int, end: int | None = None, inside: bool = False) -> Iterator[tuple[int, str]]:
    """(offset, line) of the complete lines that begin from ``start`` on and before ``end``; a
    last one without a line feed is left for the next time. With ``inside`` a line may be
    under way at ``start``, and isn't one of these. Bytes that are no UTF-8 are replaced."""
    with _open(path) as f:
        at = start - 1 if inside and start else start
        f.seek(at)
        skip, rest = inside and start > 0, b""
        while True:
            block = f.read(1 << 20)
            if not block:
                return
            lines = (rest + block).split(b"\n")
            rest = lines.pop()
            for line in lines:
                if skip:
                    skip = False
                elif end is not None and at >= end:
                    return
                else:
                    yield at, line.decode("utf-8", "replace").rstrip("\r")
                at += len(line) + 1


class _Span(InputPartition):
    def __init__(self, path: str, start: int, end: int, inside: bool = False):
        super().__init__(None)
        self.path, self.start, self.end, self.inside = path, start, end, inside


def _spans(path: str, start: int, end: int) -> list[InputPartition]:
    """Stretches of a file, from a line's beginning on."""
    return [_Span(path, at, min(end, at + SPAN), at > start) for at in range(start, end, SPAN)]


def _end(path: str) -> int:
    """Where the last complete line ends."""
    at = size_of(path)
    with _open(path) as f:
        while at > 0:
            step = min(1 << 16, at)
            f.seek(at - step)
            k = f.read(step).rfind(b"\n")
            if k >= 0:
                return at - step + k + 1
            at -= step
    return 0


class _Batch(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> list[InputPartition]:
        return [x for p, size, _ in _files(self.root) for x in _spans(p, 0, size)] or [_Span("", 0, 0)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        if partition.path:
            for at, line in complete_lines(partition.path, partition.start, partition.end, partition.inside):
                if line.strip():
                    yield partition.path, at, line


class _Tail(DataSourceStreamReader):
    """Offsets are {path: [bytes, hash of the head]}; a rewritten file begins anew. A file that
    hasn't changed since the last look isn't opened again."""

    def __init__(self, root: str):
        self.root = root
        self.seen: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for path, size, changed in _files(self.root):
            old = self.seen.get(path)
            if old is None or old[:2] != (size, changed):
                end = _end(path)
                self.seen[path] = old = (size, changed, [end, head_hash(path, end)])
            out[path] = old[2]
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path, (upto, now) in end.items():
            at, seen = start.get(path, [0, None])
            if [at, seen] == [upto, now]:
                continue
            if at and rewritten(path, at, seen):
                at = 0
            out += _spans(path, at, upto)
        return out or [_Span("", 0, 0)]

    read = _Batch.read

    def commit(self, end: dict) -> None:
        pass


class JsonlTail(DataSource):
    """``spark.read.format("jsonl_tail").load(folder)``, and the same with readStream."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonlTail)
    spark.dataSource.register(NpyFile)


class _Rows(InputPartition):
    def __init__(self, begin: int, end: int):
        super().__init__(None)
        self.begin, self.end = begin, end


class _NpyReader(DataSourceReader):
    """Spans of rows, as Arrow batches without a copy of each row."""

    def __init__(self, path: str):
        self.path = path

    def _array(self):
        import numpy as np

        a = np.load(self.path, mmap_mode="r", allow_pickle=False)
        if a.dtype != np.dtype("<f4") or a.ndim not in (1, 2) or (a.ndim == 2 and not a.flags.c_contiguous):
            raise ValueError("only little-endian float32 arrays of one or two dimensions in C order are read")
        return a if a.ndim == 2 else a[:, None]

    def partitions(self) -> list[InputPartition]:
        a = self._array()
        step = max(1, SPAN // max(1, a.shape[1] * 4))
        return [_Rows(i, min(len(a), i + step)) for i in range(0, len(a), step)] or [_Rows(0, 0)]

    def read(self, partition: _Rows) -> Iterator:
        import numpy as np
        import pyarrow as pa

        a = self._array()
        for i in range(partition.begin, partition.end, 8192):
            rows = np.ascontiguousarray(a[i : min(partition.end, i + 8192)])
            offsets = pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(rows))), pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))], ["rowid", "vector"])


class NpyFile(DataSource):
    """``spark.read.format("npy").load(file)``: (rowid, vector) of a NumPy file."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "rowid long, vector array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options["path"])


def checkpoint_rows(spark: SparkSession, root: str, errors: DataFrame | None = None, now: str = "") -> DataFrame:
    """(log_path, byte_offset, content_head_hash, last_ingested_at, last_error) of the files
    read so far; ``errors``: (log_path, byte_offset, error)."""
    import pyarrow as pa

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = b.column(0).to_pylist()
            ends = [_end(p) for p in paths]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ends, pa.int64()), pa.array([head_hash(p, e) for p, e in zip(paths, ends)], pa.string())], ["log_path", "byte_offset", "content_head_hash"])

    paths = spark.createDataFrame([(p,) for p, _, _ in _files(root)], "log_path string")
    out = paths.mapInArrow(look, "log_path string, byte_offset long, content_head_hash string").withColumn("last_ingested_at", F.lit(now))
    if errors is None:
        return out.withColumn("last_error", F.lit(None).cast("string"))
    last = errors.groupBy("log_path").agg(F.max_by("error", "byte_offset").alias("last_error"))
    return out.join(last, "log_path", "left")
