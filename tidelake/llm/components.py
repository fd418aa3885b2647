"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import removed, written


def _large(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node with the least of its neighbours and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Links every smaller neighbour of a node, and the node, with the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    inner = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return inner.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): for each node of ``edges`` (u, v: long) that is not the least of its component, that least node.

    Rounds of large and small stars go on until the edges stay as they are, which takes a logarithmic number of
    rounds; each round's edges are a table in the shared folder. No edge or label reaches the driver, only a count
    and a checksum of each round. Loops and repeated edges are allowed; an empty graph gives no rows.
    """
    now = written(edges.where("u <> v").select("u", "v").distinct())
    was = None
    while True:
        # a decimal sum can't overflow
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if sign == was or not sign[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
        was = sign
        after = written(_small(_large(now)))
        removed(now)
        now = after
