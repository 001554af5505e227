"""Connected components of a graph given by its edges, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spill


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of each node's component.

    Alternates two steps until nothing changes: every node's larger neighbours are linked to its smallest
    neighbour, then its smaller ones.  The number of edges never grows and the number of steps
    is about the logarithm of the longest path.  Nulls and loops are dropped; no edges: no rows.
    """
    now = edges.select(F.least(a, b).cast("long").alias("v"), F.greatest(a, b).cast("long").alias("u")).where("u <> v").distinct()
    now = spill(now, "edges")
    mark = None
    while True:
        # large star: for all neighbours, larger ones are linked to the smallest (or the node itself)
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = spill(both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = spill(large.where("u <> v").distinct(), "large")
        # small star: for the smaller neighbours
        first = spill(large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")), "least")
        small = large.join(first, F.col("u") == F.col("k")).select(F.col("v").alias("x"), "m", F.col("u"))
        small = small.select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = spill(small.where("u <> v").distinct(), "edges")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    labels = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
