"""Connected components of a link table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label`` (the smallest node it reaches) for every node of the links.

    Each round takes the smallest label among a node's neighbours and then the label of that
    label, so the rounds grow with the logarithm of a chain's length, not with the length.
    Every round is written to the shared folder.  Nothing is collected but a count.  Joins are
    on written tables, so that a label that many nodes share is a skewed shuffle that adaptive
    execution splits.
    """
    two = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    two = written(two.union(two.select("v", "u")).where("u <> v").distinct(), "edges")
    near = two.groupBy("u").agg(F.min("v").alias("m"))
    labels = written(near.select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        seen = two.join(labels, two["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("m"))
        best = labels.join(seen, labels["node"] == seen["u"]).select(
            "node", F.col("label").alias("old"), F.least("label", "m").alias("label")
        )
        best = written(best, "labels")
        of = best.select(F.col("node").alias("at"), F.col("label").alias("further"))
        jumped = written(
            best.join(of, best["label"] == of["at"]).select("node", "old", F.least("label", "further").alias("label")),
            "labels",
        )
        if jumped.where("old <> label").isEmpty():
            return jumped.select("node", "label")
        labels = jumped.select("node", "label")
