"""Connected components of an edge table by repeated hooking to smaller labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantledger.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``: ``label`` is the smallest node it is connected with.

    Each round gives a node the smallest label among its neighbours, then gives all nodes of one label the smallest
    label any of them saw, so that label trees join whole; rounds grow with the logarithm of the longest path. Minima are combined
    before each shuffle, and every table that is joined stands written, so a node with very many links is split.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(edges.select(F.explode(ways).alias("e")).select("e.*").distinct(), "edges")
    labels = written(both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct(), "labels")
    if labels.isEmpty():
        return labels
    while True:
        seen = (both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("seen")))
        near = written(labels.join(seen, labels["node"] == seen["a"])
                       .select("node", "label", F.least("label", "seen").alias("near")), "near")
        trees = written(near.groupBy(F.col("label").alias("root")).agg(F.min("near").alias("low")), "trees")
        hooked = near.join(trees, near["label"] == trees["root"]).select("node", "label", F.col("low"))
        # The tree's lowest label may itself hang below another by now: follow it once.
        up = trees.select(F.col("root").alias("via"), F.col("low").alias("lower"))
        moved = written(hooked.join(up, hooked["low"] == up["via"], "left").select(
            "node", F.coalesce("lower", "low").alias("label"), F.col("label").alias("old")), "labels")
        labels = moved.select("node", "label")
        if moved.where("label <> old").isEmpty():
            return labels
