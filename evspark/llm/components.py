"""Connected components of an edge table, by alternating large-star and small-star joins.

Nodes may be of any type that Spark orders. Each round is two grouped minima, which combine on the map side,
and two joins, in which Spark splits hot keys; rounds grow with the logarithm of the longest path. Every
round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evspark.llm import shared


def _round(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with a > b, drawn closer to the least node of their component."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # stored before the join, so that Spark can split a node with many neighbours on either side
    least = shared.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, root) of every node that is not the least of its component; edges are (a, b), loops and repeats allowed.

    A null end makes no edge. Without edges the result has no rows. With ``rounds`` it stops early: nodes with the same
    root are connected, but a component may have several roots, and a node several rows.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = shared.stored(edges.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "edges")
    state = _state(now)
    while state[0] and rounds != 0:
        rounds = None if rounds is None else rounds - 1
        now = shared.stored(_round(now), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def least_member(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root, component_id): the least ``id`` in the node's component, for ``nodes`` (node, id) and edges (a, b)."""
    roots = nodes.join(connected_components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = shared.stored(roots.select("node", "root", "id"), "roots")
    least = shared.stored(roots.groupBy("root").agg(F.min("id").alias("component_id")), "least")
    return roots.join(least, "root").select("node", "root", "component_id")
