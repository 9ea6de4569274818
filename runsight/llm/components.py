"""Connected components of an edge table, without collecting edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reachable. ``edges``: a, b longs; nodes without edges are absent.

    Each round takes the smallest label among a node and its neighbours, then follows labels once more (pointer
    jumping), so the number of rounds grows with the logarithm of the longest path. Rounds are written tables.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near")))
        nearer = (labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")))
        # a label is a node: its own label is as good. Labels that are told so pull their members along.
        pulled = nearer.groupBy(F.col("old").alias("node")).agg(F.min("component").alias("pulled"))
        told = (nearer.join(pulled, "node", "left").select("node", "old", F.least("component", F.coalesce("pulled", "component")).alias("component")))
        jump = told.select(F.col("node").alias("to"), F.col("component").alias("further"))
        after = written(told.join(jump, told["component"] == jump["to"], "left").select(
            "node", "old", F.least("component", F.coalesce("further", "component")).alias("component")), "labels")
        if after.filter("component <> old").isEmpty():
            return after.select("node", "component")
        labels = after.select("node", "component")
