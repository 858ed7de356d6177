"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step sends a node's neighbours to the smallest of them with joins and aggregates of two long
columns; no neighbourhood is collected. Steps are stored, so a lost executor repeats one step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.session import store

MAX_ROUNDS = 60  # the number of rounds grows with the logarithm of a component's size


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link every neighbour of a node (itself included) to the smallest of them."""
    both = edges if larger_only else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if larger_only:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if larger_only:
        moved = joined.select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m"))
    else:
        moved = joined.filter("b > a").select(F.col("b").alias("x"), "m")
    return moved.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (a, b: long); component is its smallest node.

    Links of a node with itself and repeated links count for nothing."""
    edges = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .filter("a <> b").distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        edges = store(_star(_star(edges, False), True))
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s"),
                         F.countDistinct("a").alias("d")).first()
        if mark == (seen.n, seen.s) and seen.n == seen.d:
            break
        mark = (seen.n, seen.s)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
