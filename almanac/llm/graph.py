"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """links: a, b (bigint). Returns node, component (the smallest node reachable), for nodes with links.

    Every round each node picks its smallest neighbour. Picks form trees (only two nodes that pick each other
    close a circle, and the smaller of them becomes the root), each of two nodes at least. Roots are found by
    pointer jumping and every tree becomes one node, so the nodes that still have links at least halve in a
    round, whatever the order of ids along a chain; the rounds end when no link is left. Each round's tables are
    stored, and only whether any row is left reaches the driver. All joins are plain equi-joins, which AQE
    splits where one node is frequent."""
    l = links.filter("a <> b")
    edges = stored(l.select("a", "b").union(l.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = None
    while True:
        root = _roots(edges)
        if labels is None:
            labels = root.withColumnRenamed("root", "component")
        else:  # a tree without links left is a whole component and keeps its root
            at = root.withColumnRenamed("node", "component")
            labels = stored(labels.join(at, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "cc-labels")
        a, b = (root.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
        edges = stored(edges.join(a, "a").join(b, "b").filter("a_root <> b_root")
                       .select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "cc-edges")
        if not edges.limit(1).count():
            break
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return stored(labels.join(least, "component").select("node", F.col("least").alias("component")), "cc-components")


def _roots(edges: DataFrame) -> DataFrame:
    """node, root: the root of the tree that the nodes' picks form."""
    pick = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "cc-picks")
    back = pick.select(F.col("node").alias("root"), F.col("root").alias("back"))
    mutual = (F.col("back") == F.col("node")) & (F.col("node") < F.col("root"))
    tree = stored(pick.join(back, "root").select("node", F.when(mutual, F.col("node")).otherwise(F.col("root")).alias("root")), "cc-trees")
    while True:
        of = tree.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stored(tree.join(of, "root").select("node", F.col("root").alias("old"), F.col("next").alias("root")), "cc-trees")
        tree = new.select("node", "root")
        if not new.filter("old <> root").limit(1).count():
            return tree
