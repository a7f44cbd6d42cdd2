"""Connected components of a graph of links, by alternating large-star and small-star rounds.

Each round is joins and aggregations over edges; a node with very many links is aggregated partially, and what
is known of it is sent to its edges by broadcast. The edges after each round are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.skewed import joined
from docquarry.session import saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return joined(both.where("v > u"), least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge leads down (b < a), and a node has as many as it has distinct smaller neighbours.
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    near = joined(edges, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Every node with an edge down has one, and it leads to a node that has none."""
    down = edges.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
    long = down.join(down.select(F.col("a").alias("b")), "b", "left_semi")
    return down.where("n > 1").select("a").unionByName(long.select("a")).isEmpty()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component: the least node reachable, for every node of links (a long, b long).

    Both steps keep what is connected, and lead down; so once the edges are stars, each centre is the least
    node of its component.
    """
    edges = saved(links.where("a != b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "stars")
    for _ in range(most_rounds):
        if _are_stars(edges):
            break
        edges = saved(_small_star(saved(_large_star(edges), "large-stars")), "stars")
    else:
        raise RuntimeError("components have not settled")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
