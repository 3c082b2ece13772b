"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadweave.llm.tables import delete_tables, table


def _around(edges: DataFrame) -> DataFrame:
    """(u, m): each node with the smallest node among its neighbours and itself."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = table(_around(both), "large")
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), least


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = table(_around(down), "small")
    stars = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stars.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v"), least


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none itself."""
    ends = edges.select(F.col("u").alias("n"), F.col("v").alias("p"), F.lit(0).alias("is_parent")).unionByName(
        edges.select(F.col("v").alias("n"), F.lit(None).cast("long").alias("p"), F.lit(1).alias("is_parent")))
    node = ends.groupBy("n").agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.max("is_parent").alias("is_parent"))
    return node.where("lo <> hi or (lo is not null and is_parent = 1)").isEmpty()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): each node of an edge with the smallest node that it reaches.

    Each round joins the edges with one minimum per node. The minima are written first, so both
    sides of the join are plain exchanges and the adaptive join splits the hub of a large component.
    Nulls and loops are no edges; an empty table gives no rows.
    """
    now = table(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _stars(now):
        large, least = _large_star(now)
        mid = table(large, "stars")
        delete_tables(least, now)
        small, least = _small_star(mid)
        now = table(small.distinct(), "stars")
        delete_tables(least, mid)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
