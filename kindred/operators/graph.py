"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.storage import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that a link (its two columns, longs) joins to another; component: its smallest node.

    Every node hooks onto its smallest neighbour, chains of hooks are halved until each node hangs on a root, and the links
    between roots are what the next round looks at, until there are none.  Neighbours are aggregated, never gathered.
    """
    a, b = links.columns
    edges = materialise(links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y").distinct(), "links")
    label = materialise(edges.select(F.col("x").alias("node")).union(edges.select("y")).distinct().withColumn("component", F.col("node")), "labels")
    while edges.count():
        both = edges.union(edges.select("y", "x"))
        up = materialise(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("y")), "hooks")
        while True:
            above = up.select(F.col("x").alias("y"), F.col("y").alias("z"))
            nearer = materialise(up.join(above, "y").select("x", F.col("z").alias("y"), (F.col("y") != F.col("z")).alias("moved")), "hooks")
            up = nearer.select("x", "y")
            if not nearer.where("moved").limit(1).count():
                break
        label = materialise(label.join(up.select(F.col("x").alias("component"), F.col("y").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        ends = edges.join(up.select("x", F.col("y").alias("a")), "x").join(up.select(F.col("x").alias("y"), F.col("y").alias("b")), "y")
        edges = materialise(ends.where("a <> b").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct(), "links")
    return label
