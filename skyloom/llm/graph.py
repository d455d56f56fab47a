"""Connected components of a link table by contraction; every round is written to the shared folder.

In a round every node goes over to the first of itself and its neighbours, in an order of hashes (by ids a chain would shrink by one node
a round, by hashes it shrinks by a share). Links between the nodes that are left go on to the next round, so the rounds together handle few
more links than the first. A hub costs no more than its links: minima combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def undirected(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b); the component is its smallest node. Links of a node with itself are none; no links give no rows."""
    edges = materialize(links.filter("a <> b").select(*undirected("a", "b")).distinct(), "links")
    labels = None
    while labels is None or not edges.isEmpty():
        place = lambda c: F.struct(F.xxhash64(c), F.col(c))
        near = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min(place("b")).alias("near"))
        step = materialize(near.select(F.col("a").alias("node"), F.when(place("a") < F.col("near"), F.col("a")).otherwise(F.col("near")["b"]).alias("to")), "labels")
        ends = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("to_a")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("to_b")), "b")
        edges = materialize(ends.filter("to_a <> to_b").select(*undirected("to_a", "to_b")).distinct(), "links")
        if labels is None:
            labels = step
        else:
            labels = materialize(labels.join(step.withColumnRenamed("node", "at").withColumnRenamed("to", "next"), labels["to"] == F.col("at"), "left").select("node", F.coalesce("next", "to").alias("to")), "labels")
    least = labels.groupBy("to").agg(F.min("node").alias("component"))
    return materialize(labels.join(least, "to").select("node", "component"), "labels")
