"""Connected components of a graph given as a table of edges, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import keep


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node and component (the smallest node that it is linked with) of every node of the edges.

    Each round hands every node the smallest component among its neighbours and then the component of its component
    (pointer jumping), until nothing changes.  A node with very many neighbours is pre-aggregated before each shuffle,
    and the join that reads its label has a second key, so that Spark can split it.
    """
    both = edges.select(F.col(left).alias("u"), F.col(right).alias("v"))
    both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    both = keep(both)
    labels = keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("c")).withColumnRenamed("u", "node"))
    spread = lambda c: F.pmod(c, F.lit(1024)).alias("k")
    while True:
        told = both.select("u", "v", spread(F.col("v"))).join(labels.select(F.col("node").alias("v"), F.col("c").alias("cv"), spread(F.col("node"))), ["v", "k"])
        least = told.groupBy("u").agg(F.min("cv").alias("cv"))
        one = labels.join(least, labels["node"] == least["u"]).select("node", F.least("c", "cv").alias("c"), F.col("c").alias("old"))
        one = keep(one)
        # a component's own label; many nodes can share one
        jump = one.select(F.col("node").alias("root"), F.col("c").alias("up"), spread(F.col("node")))
        two = one.withColumn("root", F.col("c")).withColumn("k", spread(F.col("c"))).join(jump, ["root", "k"])
        two = keep(two.select("node", F.least("c", "up").alias("c"), (F.least("c", "up") < F.col("old")).alias("changed")))
        labels = two.select("node", "c")
        if not two.filter("changed").limit(1).count():
            return labels.select("node", F.col("c").alias("component"))
