"""Connected components of a large graph by alternating stars, in Spark joins.

Each round moves edges toward the smallest node a node can see; a chain of n
nodes takes about log2(n) rounds. Edges of a round are checkpointed, so lost
executors cost one round, and nothing is gathered on the driver but one count
and one checksum a round. Nodes of any orderable type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linecue.llm.common import checkpointed, joined_apart


def _smallest(edges: DataFrame) -> DataFrame:
    """Directed edges (u, v) with the smallest node among u and all its v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return joined_apart(edges, least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node of an edge (a, b)."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, known = checkpointed(now), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _smallest(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        now = checkpointed(small)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == known:
            break
        known = seen
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(now.select("v", "v").distinct())
