"""Running values over ordered groups of any size.

A plain window puts a whole group into one task. Here a group is cut into blocks of its
integer order: inside a block a window does the work, one row for each block carries the
state over, and a join hands it back. The state rows are as few as the blocks, so a
group that holds a third of all rows is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 100_000


def _blocked(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.coalesce(F.col(order), F.lit(0)) / F.lit(block)).cast("long"))


def _keyed(keys: list[str], a: DataFrame, b: DataFrame) -> Column:
    on = a["_block"] == b["_b"]
    for i, k in enumerate(keys):
        on = on & a[k].eqNullSafe(b[f"_k{i}"])
    return on


def carry_forward(df: DataFrame, keys: list[str], order: str, columns: list[str], ties: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """Each of ``columns`` as its last non-null value up to and with the row."""
    rows = _blocked(df, order, block)
    inside = Window.partitionBy(*keys, "_block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    for c in columns:
        rows = rows.withColumn(f"_in_{c}", F.last(c, ignorenulls=True).over(inside))
    at = F.struct(F.col(order), *[F.col(t) for t in ties])
    last = _blocked(df, order, block).groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b")).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(f"_out_{c}") for c in columns])
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    for c in columns:
        last = last.withColumn(f"_out_{c}", F.last(f"_out_{c}", ignorenulls=True).over(before))
    out = rows.join(last, _keyed(keys, rows, last), "left")
    return out.select(*[F.coalesce(f"_in_{c}", f"_out_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, name: str, ties: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """``name``: the sum of ``value`` up to and with the row."""
    rows = _blocked(df.withColumn("_value", value), order, block)
    inside = Window.partitionBy(*keys, "_block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b")).agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*[f"_k{i}" for i in range(len(keys))]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    rows = rows.withColumn("_inside", F.sum("_value").over(inside))
    return rows.join(sums, _keyed(keys, rows, sums), "left").select(*df.columns, (F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0))).alias(name))


def sequence_numbers(df: DataFrame, keys: list[str], order: str, name: str, ties: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """``name``: 0, 1, 2 ... in order within each group."""
    return running_sum(df, keys, order, F.lit(1).cast("long"), "_n", ties, block).withColumn(name, F.col("_n") - 1).drop("_n")


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, take: list[str], block_seconds: int = 86_400) -> DataFrame:
    """Left rows with ``take`` of the latest right row whose time is not after theirs.

    Times are seconds (long). Null times match nothing; of right rows at the same second
    the one with the greatest ``take`` counts.
    """
    marks = right.where(F.col(right_at).isNotNull()).groupBy(*keys, F.col(right_at).alias("_at")).agg(F.max(F.struct(*take)).alias("_take"))
    a = left.withColumn("_left", F.struct(*left.columns)).select(*keys, F.col(left_at).alias("_at"), F.lit(1).alias("_side"), "_left", F.lit(None).cast(marks.schema["_take"].dataType).alias("_take"))
    b = marks.select(*keys, "_at", F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), "_take")
    both = carry_forward(a.where("_at is not null").unionByName(b), keys, "_at", ["_take"], ("_side",), block_seconds)
    found = both.where("_side = 1").select("_left.*", *[F.col(f"_take.{t}").alias(t) for t in take])
    lost = left.where(F.col(left_at).isNull()).select(*left.columns, *[F.lit(None).cast(right.schema[t].dataType).alias(t) for t in take])
    return found.unionByName(lost)


def longest_prefix(left: DataFrame, path: str, prefixes: DataFrame, prefix: str, take: str) -> DataFrame:
    """Left rows with ``take`` of the longest directory that holds ``path`` or is it.

    A path is exploded to its ancestors, so the join is an equi-join of any size.
    """
    steps = F.split(F.col("_path"), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    parts = left.select(F.col(path).alias("_path")).where("_path is not null").distinct().select("_path", F.explode(up).alias("_prefix"))
    known = prefixes.select(F.col(prefix).alias("_prefix"), F.col(take).alias("_take"))
    best = parts.join(known, "_prefix").groupBy("_path").agg(F.max(F.struct(F.length("_prefix").alias("n"), "_take")).alias("_best"))
    return left.join(best, F.col(path) == F.col("_path"), "left").select(*left.columns, F.col("_best._take").alias(take))
