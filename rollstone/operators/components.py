"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..work import discard, durable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node. Null ends are ignored.

    Each round takes the least label among the neighbours, then follows the label's own label, so the number of rounds is about
    the logarithm of the longest way. Labels are written to the shared folder between rounds; nothing is collected but a count.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node IS NOT NULL AND other IS NOT NULL")
    both = durable(both.union(both.select("other", "node")).distinct(), "edges")
    labels = durable(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("near", "component").alias("mid"))
        onward = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        new = durable(least.join(onward, "mid", "left").select("node", "old", F.least("mid", "far").alias("component")), "labels")
        discard(labels)
        labels = new
        if not new.where("component <> old").limit(1).count():
            discard(both)
            return labels.select("node", "component")
