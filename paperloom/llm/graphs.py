"""Connected components of a stored edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every end of an edge ``(a, b)``; the label is the smallest node reachable.

    Each round gives a node the smallest label of its neighbours, hands the smallest label
    that any member saw to the root of its group, and follows labels one step further, so
    groups at least double and long chains take a logarithmic number of rounds. A round is
    stored, so that both sides of the next joins are plain shuffles, which adaptive
    execution splits at a hub, and minima are formed before the shuffle.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst")
    both = materialize(both.union(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
    labels = materialize(
        both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near"))
        .select("node", F.least("node", "near").alias("label"), F.lit(True).alias("changed")),
        "labels",
    )
    while labels.where("changed").limit(1).count():
        known = labels.select("node", "label")
        near = both.join(known.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("label").alias("near"))
        seen = known.join(near.withColumnRenamed("src", "node"), "node")
        hooks = seen.groupBy(F.col("label").alias("node")).agg(F.min("near").alias("hook"))
        moved = seen.join(hooks, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near", "hook").alias("via"))
        jump = known.select(F.col("node").alias("via"), F.col("label").alias("far"))
        labels = materialize(
            moved.join(jump, "via").select("node", F.least("via", "far").alias("label"), (F.least("via", "far") < F.col("old")).alias("changed")),
            "labels",
        )
    return labels.select("node", "label")
