"""Connected components by contraction, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import checkpoint, release


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for the ends of links ``a``, ``b``.

    Every round points each node at its smallest neighbour if that is smaller,
    follows the pointers to their ends by doubling, and contracts the links.
    """
    edges = checkpoint(links.select("a", "b").where("a <> b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = checkpoint(nodes.withColumn("root", F.col("node")))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p"))
        up = checkpoint(up.select("node", F.least("node", "p").alias("p"), F.lit(True).alias("moved")))
        while not up.where("moved").isEmpty():
            above = up.select(F.col("node").alias("p"), F.col("p").alias("q"))
            moved = up.drop("moved").join(above, "p").select("node", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved"))
            up = _next(moved, up)
        to = up.select(F.col("node").alias("root"), "p")
        roots = _next(roots.join(to, "root", "left").select("node", F.coalesce("p", "root").alias("root")), roots)
        ends = edges.join(up.select(F.col("node").alias("a"), F.col("p").alias("pa")), "a")
        ends = ends.join(up.select(F.col("node").alias("b"), F.col("p").alias("pb")), "b")
        contracted = ends.select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct()
        edges = _next(contracted, edges, up)
    release(edges)
    return roots


def _next(df: DataFrame, *old: DataFrame) -> DataFrame:
    new = checkpoint(df)
    release(*old)
    return new
