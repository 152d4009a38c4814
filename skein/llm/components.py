"""Connected components of an edge table by alternating large and small stars.

Every round is two grouped joins on the edge table, whose size never grows; each round is written to
the shared folder, so neither lineage nor the driver's memory grows with the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.storage import Workspace


def _least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u and its partners."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v"), F.col("u")))
    return _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _least(down)
    moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(linked.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(u, root) for every node of ``edges`` (u, v) but the roots; root is the least node reachable.

    Nulls are not allowed in ``edges``; loops and repeated edges are harmless.
    """
    now = work.put(edges.select("u", "v").where("u <> v").distinct(), "edges0")
    mark, step = None, 0
    while True:
        step += 1
        now = work.put(_small_star(_large_star(now)), f"edges{step}")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(f"edges{step - 1}")
        if tuple(seen) == mark:
            return now.select("u", F.col("v").alias("root"))
        mark = tuple(seen)
