"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelmill.session import checkpoint


def _star(directed: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours under the least member of each neighbourhood. The minimum is a partial aggregate and the join
    is one that adaptive execution can split, so that a hub doesn't meet in one task. It is sorted on both sides: sizes guessed from
    compressed files would have nodes by the million gathered in the driver for a broadcast."""
    least = directed.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = directed.join(least.hint("merge"), "a")
    if larger:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge table; component is the least reachable node.

    Rounds grow with the logarithm of the diameter. Each one is checkpointed in the shared folder. Self loops and
    repeated edges are harmless; edges with a null end are ignored; an empty table gives an empty result."""
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    loops = pairs.filter(F.col("a") == F.col("b")).select("a").distinct()
    cur = checkpoint(pairs.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(cur)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = checkpoint(_star(both, True))
        cur = checkpoint(_star(large, False))
        last, mark = mark, _mark(cur)
        if mark == last:
            break
    else:
        raise RuntimeError("connected components did not settle")
    stars = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("component").alias("node")).distinct().withColumn("component", F.col("node"))
    alone = loops.select(F.col("a").alias("node"), F.col("a").alias("component"))
    found = stars.unionByName(roots)
    return found.unionByName(alone.join(found, "node", "left_anti"))
