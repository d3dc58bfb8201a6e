"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame) -> DataFrame:
    """Each node's smallest neighbour (or itself), beside each of its links."""
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return edges.join(least, "u")


def connected_components(links: DataFrame, most: int = 60) -> DataFrame:
    """``(node, component)`` for every node that a row ``(u, v)`` of links names; component: the smallest node reachable.

    Every round hangs larger neighbours on a node's smallest one, then smaller ones on the smallest of them, which
    ends in one star for each component after about log(n) rounds. No round holds a component in one task: the rows are
    links, a node's smallest neighbour is a partial aggregate, and both sides of the join are read from the shared
    folder, so that Spark may split a star's hub. Null ends and loops are left out; an empty table gives none.
    """
    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    before = None
    for _ in range(most):
        both = cut(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = cut(_star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        starred = _star(large)
        edges = cut(
            starred.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(starred.select("u", F.col("m").alias("v")))
            .where("u != v")
            .distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
