"""Connected components of an edge table by label propagation with pointer jumping, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelweave.session import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of each node of ``edges`` (a, b).

    Each round takes the smallest label next to a node and then the label of that label, so the number of rounds is
    about logarithmic in the length of a chain. Labels are written to the shared folder each round.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    label = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "label")
    held = label
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = low.join(label.select(F.col("node").alias("mid"), F.col("label").alias("up")), "mid", "left").select("node", "old", F.least("mid", "up").alias("label"))
        new = stored(jump, "label")
        done = not new.filter("label <> old").limit(1).count()
        label = new.select("node", "label")
        discard(held)
        held = new
        if done:
            return label.withColumnRenamed("label", "component")
