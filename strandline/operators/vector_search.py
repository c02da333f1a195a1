"""Nearest rows of a vector table for one query, filtered before, floored after."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import vectors as V

# --- fixed values: limits of a vector table -----------------------------------------------------
MOST_K, MOST_DIMS, MOST_BLOCK = 4096, 8192, 4096
MOST_COLUMNS = {"vector": 16, "partition": 4, "auxiliary": 16, "metadata": 16}
RRF_K, DEPTH, FLOOR = 60, 50, 0.50
# --------------------------------------------------------------------------------------------------
_VECTOR = re.compile(r"(\w+)\s+(float|f32|int8|i8|bit)\[(\d+)\](?:\s+distance_metric\s*=\s*(l2|l1|cosine))?", re.I)
_OPERATORS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


@dataclass
class VectorTable:
    """The declaration of a vector table: name -> (element type, dims, metric)."""

    vectors: dict[str, tuple[str, int, str]] = field(default_factory=dict)
    key: str = "rowid"
    partition: dict[str, str] = field(default_factory=dict)
    metadata: dict[str, str] = field(default_factory=dict)
    auxiliary: dict[str, str] = field(default_factory=dict)
    block: int = 1024

    @staticmethod
    def parse(declaration: str) -> VectorTable:
        """``id integer primary key, p text partition key, m integer, +aux text, v float[64]``."""
        t = VectorTable()
        for part in (p.strip() for p in declaration.split(",") if p.strip()):
            if m := re.fullmatch(r"chunk_size\s*=\s*(\d+)", part):
                t.block = int(m[1])
                if t.block <= 0 or t.block % 8 or t.block > MOST_BLOCK:
                    raise ValueError(f"chunk_size must be a multiple of 8 up to {MOST_BLOCK}")
            elif m := _VECTOR.fullmatch(part):
                kind = {"float": "float32", "f32": "float32", "int8": "int8", "i8": "int8", "bit": "bit"}[m[2].lower()]
                if not 0 < int(m[3]) <= MOST_DIMS:
                    raise ValueError(f"dimensions must be 1 to {MOST_DIMS}")
                if kind == "bit" and (m[4] or int(m[3]) % 8):
                    raise ValueError("bit vectors have whole bytes and no metric but Hamming")
                t.vectors[m[1]] = (kind, int(m[3]), "hamming" if kind == "bit" else (m[4] or "l2").lower())
            elif m := re.fullmatch(r"(\w+)\s+(integer|text)\s+primary\s+key", part, re.I):
                t.key = m[1]
            elif m := re.fullmatch(r"(\w+)\s+(integer|text)\s+partition\s+key", part, re.I):
                t.partition[m[1]] = m[2].lower()
            elif m := re.fullmatch(r"\+(\w+)\s+(integer|text|float|blob)", part, re.I):
                t.auxiliary[m[1]] = m[2].lower()
            elif m := re.fullmatch(r"(\w+)\s+(integer|text|float|boolean)", part, re.I):
                t.metadata[m[1]] = m[2].lower()
            else:
                raise ValueError(f"no column of a vector table: {part}")
        if not t.vectors:
            raise ValueError("a vector table needs a vector column")
        for what, n in (("vector", t.vectors), ("partition", t.partition), ("auxiliary", t.auxiliary), ("metadata", t.metadata)):
            if len(n) > MOST_COLUMNS[what]:
                raise ValueError(f"at most {MOST_COLUMNS[what]} {what} columns")
        return t

    def predicate(self, column: str, op: str, value: object) -> Column:
        """A filter that may be applied before the search."""
        if column in self.auxiliary:
            raise ValueError("auxiliary columns can't be filtered in a search")
        if column == self.key:
            if op != "in":
                raise ValueError("the key takes IN only")
            return F.col(column).isin(list(value))
        kind = self.metadata.get(column) or self.partition.get(column)
        if kind is None:
            raise ValueError(f"no such column: {column}")
        if op == "in":
            if column in self.partition or kind not in ("integer", "text"):
                raise ValueError("IN takes integer and text metadata only")
            return F.col(column).isin(list(value))
        if op not in _OPERATORS or (kind == "boolean" and op not in ("=", "!=")):
            raise ValueError(f"{op} is not possible on {kind}")
        return getattr(F.col(column), _OPERATORS[op])(F.lit(value))

    def valid(self, rows: DataFrame) -> DataFrame:
        """Rows that may be inserted: vectors of the right size, no null metadata."""
        ok = F.lit(True)
        for name, (kind, dims, _) in self.vectors.items():
            ok = ok & (V.vec_length(name, kind) == dims)
        for name in [*self.metadata, *self.partition]:
            ok = ok & F.col(name).isNotNull()
        return rows.where(F.coalesce(ok, F.lit(False)))

    def insert(self, rows: DataFrame, new: DataFrame) -> DataFrame:
        """``rows`` with the valid ones of ``new`` whose key is not taken; of repeated new
        keys one counts."""
        fresh = self.valid(new).dropDuplicates([self.key]).join(rows.select(self.key), self.key, "left_anti")
        return rows.unionByName(fresh.select(*rows.columns))

    def delete(self, rows: DataFrame, keys: DataFrame) -> DataFrame:
        """``rows`` without those whose key is in ``keys``."""
        return rows.join(keys.select(self.key), self.key, "left_anti").select(*rows.columns)

    def update(self, rows: DataFrame, changes: DataFrame) -> DataFrame:
        """``rows`` with the columns of ``changes`` (one row for each key) where these aren't
        null. A changed partition key or a vector of another size raises."""
        new = changes.dropDuplicates([self.key]).select(F.col(self.key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in changes.columns if c != self.key])
        both = rows.join(new, F.col(self.key) == F.col("_key"), "left")
        out = []
        for c in rows.columns:
            if c == self.key or c not in changes.columns:
                out.append(F.col(c))
                continue
            value = F.coalesce(F.col(f"_{c}"), F.col(c))
            if c in self.partition:
                value = F.when(F.col(f"_{c}").isNotNull() & ~F.col(f"_{c}").eqNullSafe(F.col(c)), F.raise_error(F.lit("a partition key can't be changed"))).otherwise(F.col(c))
            elif c in self.vectors:
                kind, dims, _ = self.vectors[c]
                value = F.when(F.col(f"_{c}").isNotNull() & (V.vec_length(f"_{c}", kind) != dims), F.raise_error(F.lit("a vector of another size"))).otherwise(value)
            out.append(value.alias(c))
        return both.select(*out)

    def describe(self) -> list[tuple[str, str, str]]:
        """(column, role, type) of the declaration."""
        out = [(self.key, "key", "")]
        out += [(c, "partition", k) for c, k in self.partition.items()] + [(c, "metadata", k) for c, k in self.metadata.items()] + [(c, "auxiliary", k) for c, k in self.auxiliary.items()]
        return out + [(c, "vector", f"{k}[{n}] {m}") for c, (k, n, m) in self.vectors.items()]


def vectors_of_blob(spark: SparkSession, blob: bytes, dims: int) -> DataFrame:
    """(rowid, vector) of raw little-endian float32 bytes, as a table."""
    if dims <= 0 or len(blob) % (4 * dims):
        raise ValueError("the bytes are no whole vectors")
    import numpy as np
    import pyarrow as pa

    flat = pa.array(np.frombuffer(blob, dtype="<f4"))
    n = len(flat) // dims
    return spark.createDataFrame(pa.table({"rowid": pa.array(range(n), pa.int64()), "vector": pa.FixedSizeListArray.from_arrays(flat, dims).cast(pa.list_(pa.float32()))}))


def knn(rows: DataFrame, query: list[float], k: int, metric: str = "cosine", vector: str = "embedding", key: str = "chunk_id", where: Column | None = None, floor: float | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, distance, *keep) of the k nearest rows, ties by key.

    ``where`` is applied before the distances (and reaches the scan), ``floor`` after the
    k. Rows without a distance (null or zero vectors) are no candidates. Per-partition
    top-k and merge is what Spark plans for it; only k rows are exchanged from each.
    """
    if not 0 <= k <= MOST_K:
        raise ValueError(f"k must be 0 to {MOST_K}")
    if len(query) > MOST_DIMS:
        raise ValueError("too many dimensions")
    q = F.lit(bytes(query)) if metric == "hamming" else F.array(*[F.lit(float(x)).cast("float") for x in query])
    near = rows.where(where) if where is not None else rows
    near = near.where(F.col(vector).isNotNull()).select(key, *keep, V.DISTANCES[metric](vector, q).alias("distance")).where("distance is not null and not isnan(distance)")
    near = near.orderBy("distance", key).limit(k)
    return near.where(F.col("distance") <= floor) if floor is not None else near


def fuse(*rankings: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, score): reciprocal-rank fusion of rankings (key, r), r from 1."""
    both = rankings[0].select(key, "r")
    for x in rankings[1:]:
        both = both.unionByName(x.select(key, "r"))
    return both.groupBy(key).agg(F.sum(F.lit(1.0) / (F.lit(float(RRF_K)) + F.col("r"))).alias("score"))


def ranked(rows: DataFrame, by: str, key: str = "chunk_id", depth: int = DEPTH) -> DataFrame:
    """(key, r) of the best ``depth`` rows; the limit comes first, so the window over one
    partition holds no more than these."""
    from pyspark.sql import Window

    return rows.orderBy(by, key).limit(depth).select(key, F.row_number().over(Window.orderBy(by, key)).alias("r"))
