"""Connected components by alternating large-star and small-star joins.

Published as "Connected Components in MapReduce and Beyond" (Kiveris et al.,
2014). Each step is an aggregation (the least neighbour of every vertex) and a
join; no neighbourhood is ever collected, so a hub of any degree is only a hot key
of an aggregate with map-side combine and of a join that adaptive execution
splits. The number of rounds is logarithmic for practical graphs. Every round is
cut through the shared folder, so it outlives executors; nothing but one counter
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex sends its larger neighbours to the least vertex around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex sends its smaller neighbours, and itself, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) of every vertex on an edge; the component is the least
    vertex of it.

    Null ends drop an edge, loops and repeated edges count once, an empty graph has
    no rows. Vertices may be of any ordered type, the same on both sides.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    vertices = ends.select("a").union(ends.select("b")).distinct()
    now = cut(ends.where("a <> b").distinct())

    def state(e: DataFrame) -> tuple:
        return e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40)), F.bit_xor(F.xxhash64("b", "a"))).first()

    was = state(now)
    while was[0]:
        now = cut(_small_star(_large_star(now)))
        new = state(now)
        if new == was:
            break
        was = new
    return vertices.join(now.select(F.col("a").alias("v"), F.col("b").alias("m")), F.col("a") == F.col("v"), "left").select(F.col("a").alias("vertex"), F.coalesce("m", "a").alias("component"))
