"""Connected components of an edge table by alternating star operations, cut into
the shared folder after every round. No component is ever gathered in one place:
a hub is only the key of a partial aggregate and of joins that Spark can split. For
that each round's minima are written first: a join right above an aggregate would
keep all of a hub's edges in the aggregate's partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.common import cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")))
    far = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b")
    return far.where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = cut(edges.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "u"))
    near = edges.join(least, F.col("b") == F.col("u")).where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return near.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) with a < b, of any orderable type -> (node, root) of every node of an
    edge, root being the smallest node reachable. An empty table gives an empty one."""
    edges, before = cut(edges.select("a", "b").distinct()), None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        edges = cut(_small(cut(_large(edges))))
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())
