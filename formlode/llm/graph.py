"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(k, label) for every end of an edge; label is the smallest end that can be reached.

    Each round takes the least label among the neighbours, then the label of that label, so that rounds grow with the
    logarithm of the longest path. Only aggregates and joins on node ids are used; nothing is gathered. Empty edges give an
    empty table, repeated edges and loops change nothing.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = written(ends.union(ends.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.k).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.k == near.a).select("k", F.col("label").alias("was"), F.least("label", "near").alias("next"))
        up = labels.select(F.col("k").alias("next"), F.col("label").alias("up"))
        nearer = written(lower.join(up, "next").select("k", "was", F.least("next", "up").alias("label")), "labels")
        labels = nearer.select("k", "label")
        if nearer.filter("label <> was").isEmpty():
            return labels
