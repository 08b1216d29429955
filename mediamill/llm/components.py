"""Connected components of a graph too large for one machine, by label passing with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every end of ``links(a, b)``: the smallest identifier reachable.

    Each round takes the least label among a node and its neighbours, then the label of that
    label.  Labels are written after every round, so a lost executor costs one round; the
    number of rounds follows the logarithm of the longest path.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("m"))
        labels_now = labels.select("id", "component")
        least = labels_now.join(near.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        jump = labels_now.select(F.col("id").alias("component"), F.col("component").alias("jumped"))
        least = least.join(jump, "component", "left").select("id", "was", F.least("component", "jumped").alias("component"))
        least = written(least, "labels")
        dropped(labels)
        if least.where("component != was").isEmpty():
            dropped(both)
            return least.select("id", "component")
        labels = least
