"""Connected components as DataFrame iterations; neither nodes nor edges leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.storage import Workspace


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges(a, b)``; the component is its smallest node.

    Every round lowers each label to the least among the neighbours, hooks the old label itself to the least that any of its
    nodes found, and jumps to the label's own label: whole regions join, so that long chains take few rounds.  Labels only
    fall, so it ends.  Loops and repeated edges do no harm; no edges give no rows.
    """
    links = edges.where(F.col("a") != F.col("b")).select("a", "b")
    links = ws.save(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = ws.save(links.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = links.join(labels, links.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = ws.save(labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low")), "lower")
        hooks = lower.groupBy(F.col("component").alias("node")).agg(F.min("low").alias("hook"))
        hooked = ws.save(lower.join(hooks, "node", "left").select("node", "component", F.least("low", "hook").alias("low")), "hooked")
        over = hooked.select(F.col("node").alias("low"), F.col("low").alias("top"))
        new = ws.save(hooked.join(over, "low").select("node", F.least("low", "top").alias("component"), (F.least("low", "top") < F.col("component")).alias("moved")), "labels")
        ws.drop(labels, lower, hooked)
        labels = new
        if labels.where("moved").isEmpty():
            ws.drop(links)
            kept = labels.select("node", "component")
            kept._siltstone_path = labels._siltstone_path
            return kept
