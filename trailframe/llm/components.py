"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailframe.llm import common as C


def _renamed(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links between labels, once each, without those inside a component."""
    x = labels.select(F.col("node").alias("x"), F.col("label").alias("lx"))
    y = labels.select(F.col("node").alias("y"), F.col("label").alias("ly"))
    out = links.join(x, links.a == F.col("x"), "left").join(y, links.b == F.col("y"), "left")
    return out.select(F.coalesce("lx", "a").alias("a"), F.coalesce("ly", "b").alias("b")).where("a <> b").distinct()


def _composed(labels: DataFrame, parents: DataFrame) -> DataFrame:
    """Labels of labels."""
    up = parents.select(F.col("node").alias("up"), F.col("label").alias("top"))
    return labels.join(up, labels.label == up.up, "left").select("node", F.coalesce("top", "label").alias("label"))


def components(links: DataFrame) -> DataFrame:
    """links: longs a, b. Returns node, label: the smallest node that can be reached; only nodes that have links. Each round gives every
    node its smallest neighbour, or itself, follows these to their ends, and goes on with the links between ends: rounds grow with the
    logarithm of the input at worst, and links shrink in each. No links: no rows."""
    edges = C.checkpoint(links.select("a", "b").where("a <> b").distinct())
    labels = None
    while True:
        both = edges.union(edges.select("b", "a"))
        parents = C.checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
        while True:
            step = C.checkpoint(_composed(parents.select("node", "label"), parents))
            moved = step.join(parents.select(F.col("node").alias("n"), F.col("label").alias("l")), F.col("node") == F.col("n")).where("label <> l")
            parents = step
            if moved.isEmpty():
                break
        labels = parents if labels is None else C.checkpoint(_composed(labels, parents))
        edges = C.checkpoint(_renamed(edges, parents))
        if edges.isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components of the nodes of `labels` and of more links."""
    more = components(_renamed(links, labels))
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    return C.checkpoint(_composed(labels.unionByName(ends), more))
