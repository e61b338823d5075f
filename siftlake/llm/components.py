"""Connected components of a table of links, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, skew_join, written


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> node, component: the smallest node that each can reach.

    Every round gives each node the least of itself and its neighbours and contracts the links to these labels, so that few are
    left after a round or two, however large a component is; each round's links and labels are written tables, and the labels are put
together at the end. Only nodes with links are in the result.
    """
    both = links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct()
    edges = written(both.select("a", "b"), "links")
    found = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    while rows := edges.count():
        # Links are there in both directions, so n counts the rows of a node on either side; a hub's rows never meet in one task.
        label = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count(F.lit(1)).alias("n")), "labels")
        hot = hot_keys(label, "a", "n", rows)
        label = label.select("a", "label")
        found = found.join(label.withColumnRenamed("a", "component"), "component", "left").select("node", F.coalesce("label", "component").alias("component"))
        one = skew_join(edges, label, "a", hot).select(F.col("label").alias("la"), F.col("b").alias("a"))
        edges = skew_join(one, label, "a", hot).select(F.col("la").alias("a"), F.col("label").alias("b")).filter("a <> b").distinct()
        edges = written(edges, "links")
    return written(found, "components")
