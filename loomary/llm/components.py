"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every neighbour (large: those above the node; else those below it) on the node's least neighbour."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.filter("a <> b").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): every node of `edges` (a, b: long) with the least node it can reach.

    Each round is written to the shared folder, so a lost executor costs one round at most. Hubs are safe: the
    least neighbour is pre-aggregated and the join on a hub is one that adaptive execution splits. Loops (a = b)
    and repeated edges do no harm; nodes without an edge to another node aren't in the result; no edges, no rows.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _digest(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        now = written(_star(_star(now, True), False), "stars")
        mark, last = _digest(now), mark
        if mark == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return written(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots), "components")
