"""Connected components by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.scratch import drop_stored, stored


def components(edges: DataFrame, a: str, b: str, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): the least node reachable over undirected edges (a, b).

    nodes: a table with a column `node`, for those without edges. In each round a node takes the least label among
    itself and its neighbours, then its label's label, so rounds grow with the logarithm of the longest path in practice.
    The loop ends when no label changes; only that count reaches the driver. Self-edges and repeated edges are harmless,
    edges with a null end are left out.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("peer")).where("node is not null and peer is not null")
    both = stored(both.where("node <> peer").unionByName(both.where("node <> peer").select(F.col("peer").alias("node"), F.col("node").alias("peer"))).distinct())
    labels = stored(both.groupBy("node").agg(F.min("peer").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "peer"), "peer").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        # only labels in use that have a lesser label themselves are looked up: few in late rounds, when many nodes share one
        jump = labels.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("up"))
        jump = step.select("label").distinct().join(jump, "label")
        step = step.join(jump, "label", "left").select("node", "was", F.least("label", "up").alias("label"))
        step = stored(step)
        changed = step.where("label <> was").limit(1).count()
        drop_stored(labels)
        labels = step.select("node", "label")
        if not changed:
            break
    out = labels.withColumnRenamed("label", "component")
    if nodes is not None:
        alone = nodes.select("node").where("node is not null").distinct().join(out, "node", "left_anti")
        out = out.unionByName(alone.select("node", F.col("node").alias("component")))
    return out
