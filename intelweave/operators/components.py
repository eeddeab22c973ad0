"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept, lookup


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) from edges (src, dst), either way: component is the least node of the component.

    Every node goes to the neighbour, or itself, that comes first in a new random order; nodes that go to one place become
    one node. Each round leaves a part of the nodes, so rounds grow with the logarithm of their number. What a round
    leaves is a written table, and its plan is of constant size. Nodes without an edge to another one are left out.
    """
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).filter("src <> dst").distinct()
    rest, rounds = kept(both), []
    while not rest.isEmpty():
        place = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("v"))  # noqa: B023, E731
        first = rest.groupBy("src").agg(F.min(place("dst")).alias("near"), F.count(F.lit(1)).alias("n"))
        goes = kept(first.select(F.col("src").alias("node"), F.least("near", place("src"))["v"].alias("to"), "n"))
        rounds.append(goes.select("node", "to"))
        half = lookup(rest.withColumnRenamed("src", "node"), goes, ["node"], "n", "dst").select(F.col("to").alias("src"), F.col("dst").alias("node"))
        whole = lookup(half, goes, ["node"], "n", "src").select("src", F.col("to").alias("dst"))
        rest = kept(whole.filter("src <> dst").distinct())
    if not rounds:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    found = rounds.pop()
    while rounds:
        later = found.select(F.col("node").alias("__node"), F.col("to").alias("__to"))
        now = rounds.pop()
        found = kept(now.join(later, F.col("to") == F.col("__node"), "left").select("node", F.coalesce("__to", "to").alias("to")))
    least = kept(found.groupBy("to").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")))
    return lookup(found, least, ["to"], "n", "node").select("node", "component")
