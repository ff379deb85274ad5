"""Connected components of a graph given as edges, by repeated least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Workspace


def components(edges: DataFrame, work: Workspace, name: str = "cc") -> DataFrame:
    """Of edges (a, b), long: node, label (the least node reachable). Only nodes with edges appear.

    Each round takes the least label among a node and its neighbours, then that label's label; rounds grow with the
    logarithm of a component's width, and each is a written table, so no lineage builds up. Nothing but the question
    whether a label changed comes to the driver.
    """
    both = edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = work.table(f"{name}-edges", both)
    labels = work.table(f"{name}-0", both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    done = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        step = step.join(jump, "new").select("node", "label", F.least("new", "far").alias("new"))
        step = work.table(f"{name}-{done + 1}", step)
        changed = not step.where("new <> label").isEmpty()
        work.drop(f"{name}-{done}")
        done += 1
        if not changed:
            work.drop(f"{name}-edges")
            return step.select("node", F.col("new").alias("label"))
        labels = step.select("node", F.col("new").alias("label"))
