"""Connected components of an edge table by repeated contraction, all in joins and partial aggregates.

Each round every node takes the least of its neighbours and itself as parent, parents are followed one step on,
and edges are renamed to parents. Node names should be hashes, so that chains are short; then the number of
rounds grows with the logarithm of the largest component. Rounds are written to shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of every node of `edges` (a, b): label is a node of its component, the same for all of them."""
    edges = scratch.store(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.store(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).withColumn("p", F.least("node", "p")), "least")
        on = least.select(F.col("node").alias("p"), F.col("p").alias("next"))
        parents = scratch.store(least.join(on, "p").select("node", F.col("next").alias("label")), "parents")
        a, b = (parents.select(F.col("node").alias(x), F.col("label").alias(f"p{x}")) for x in "ab")
        renamed = edges.join(a, "a").join(b, "b").where("pa <> pb")
        fewer = scratch.store(renamed.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        if labels is None:
            scratch.drop(edges, least)
            edges, labels = fewer, parents
        else:
            step = parents.select(F.col("node").alias("label"), F.col("label").alias("next"))
            longer = scratch.store(labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
            scratch.drop(edges, least, parents, labels)
            edges, labels = fewer, longer
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels
