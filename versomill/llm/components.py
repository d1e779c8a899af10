"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, falls_to_scratch, new_folder, written


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """v and label, the smallest vertex of its component, for every vertex of an edge.

    ``edges`` has columns a and b.  In each round a vertex takes the smallest label
    among its own and its neighbours', then the label of that label's vertex; rounds
    end when nothing changes.  Every table that is joined is one that was written, so
    that a hub's rows can be split over tasks; nothing but a sum reaches the driver.
    Edges may come twice, either way round, or lead to themselves; those without an end
    are left out, and without edges the result is empty.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").where("a <> b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-edges")
    at = new_folder(spark, f"{tag}-0")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.min("a")).alias("label")), tag, at)
    while True:
        heard = both.join(labels, both["b"] == labels["v"]).select(F.col("a").alias("v"), "label")
        near_at = new_folder(spark, f"{tag}-near")
        near = written(heard.unionByName(labels).groupBy("v").agg(F.min("label").alias("label")), tag, near_at)
        root = near.select(F.col("v").alias("root"), F.col("label").alias("further"))
        next_at = new_folder(spark, f"{tag}-next")
        # a label is a vertex of the same component, so it has a label itself
        jumped = written(near.join(root, near["label"] == root["root"]).select("v", "label", "further"), tag, next_at).select("v", F.least("label", "further").alias("label"))
        sums = [x.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("s")).collect()[0]["s"] for x in (labels, jumped)]
        dropped(at, spark)
        dropped(near_at, spark)
        labels, at = jumped, next_at
        if sums[0] == sums[1]:  # labels only ever get smaller
            falls_to_scratch(at)
            return labels
