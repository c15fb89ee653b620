"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two aggregations (minimum neighbour per node, combined before the exchange) and two
equality joins; no neighbour list is ever gathered, so a node with a third of all edges is a row of
the minimum table and a hot key that adaptive execution splits. Each round is written to the shared
folder, which cuts the lineage at files that outlive executors.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textroute.session import materialize


def _to_minimum(edges: DataFrame, floor) -> DataFrame:
    """Edges (u, v) moved from u to u's smallest neighbour; `floor` is the minimum's expression."""
    least = edges.groupBy("u").agg(floor.alias("m")).withColumnRenamed("u", "w")
    return edges.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """`(node, root)` for every node of an edge; the root is the smallest node of its component.

    Edges with a null end or between equal ends are left out, repeated and reversed edges count
    once, and an empty table gives an empty table. Any orderable column type serves as a node.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    edges = materialize(
        edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(u.alias("u"), v.alias("v")).distinct(), "edges")
    state = _state(edges)
    while True:
        # Large star: every node hands its larger neighbours to the smallest of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_to_minimum(both, F.least("u", F.min("v")))
                 .filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = materialize(large, "large-star")
        # Small star: a node's smaller neighbours, and the node itself, go to the smallest of them.
        moved = _to_minimum(large, F.min("v"))
        small = (moved.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(moved.select("u", F.col("m").alias("v"))).distinct())
        edges, before = materialize(small, "small-star"), state
        state = _state(edges)
        if state == before:
            break
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
