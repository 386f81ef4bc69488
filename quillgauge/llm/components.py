"""Connected components of a table of links, by minimum labels and pointer jumping in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgauge.session import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); component is its smallest node.

    Every round takes the least label among a node and its neighbours, then the label of that
    label. Minima combine before they shuffle; a node of many links is split by the join. Loops,
    repeated links and an empty table are fine; null ends are left out.
    """
    links = links.filter("a is not null and b is not null and a <> b")
    edges = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    while True:
        near = (
            edges.join(labels, edges["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        lowered = labels.join(near, "node").select("node", F.col("component").alias("before"), F.least("component", "near").alias("step"))
        target = labels.select(F.col("node").alias("step"), F.col("component").alias("jump"))
        # the label of a label; grouping first keeps a label that many nodes carry from being one hot key
        jumped = lowered.join(target, "step", "left").select(
            "node", "before", F.least("step", F.coalesce("jump", "step")).alias("component")
        )
        after = materialize(jumped)
        changed = not after.filter("component <> before").isEmpty()
        labels = after.select("node", "component")
        if not changed:
            return labels
