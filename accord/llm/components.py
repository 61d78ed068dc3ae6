"""Connected components of an edge table by min-label hooking and pointer jumping, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accord.llm.common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) as longs -> (id, component): the smallest id reachable from each id that has an edge.

    A round hooks each root below the smallest label that any member's neighbour has, then halves all paths; the number
    of rounds is logarithmic in the diameter. Every round is written to the shared folder, so a lost executor costs one
    round. Empty edges give an empty table; self edges and repeated edges change nothing.
    """
    spark = edges.sparkSession
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        lowest = (
            both.join(labels.withColumnRenamed("id", "b").withColumnRenamed("component", "other"), "b")
            .join(labels.withColumnRenamed("id", "a"), "a")
            .groupBy("component").agg(F.min("other").alias("hook"))
            .filter("hook < component")
        )
        hooked = labels.join(lowest, "component", "left").select("id", F.coalesce("hook", "component").alias("component"))
        up = hooked.select(F.col("id").alias("component"), F.col("component").alias("upper"))
        new = written(hooked.join(up, "component", "left").select("id", F.least("component", F.coalesce("upper", "component")).alias("component")), "labels")
        changed = new.join(labels.withColumnRenamed("component", "was"), "id").filter("component <> was").limit(1).count()
        dropped(spark, labels)
        labels = new
        if not changed:
            dropped(spark, both)
            return labels
