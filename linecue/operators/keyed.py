"""Dealing rows by keys, and looking up rows without dealing them anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dealt(rows: DataFrame, *keys: str, tasks: int = 0) -> DataFrame:
    """rows by keys in as many tasks as the session shuffles to, `tasks` at least: what is small as it is dealt, texts say, may be much work behind, so tasks aren't joined."""
    return rows.repartition(max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def looked_up(rows: DataFrame, other: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """rows with the values of the row of `other` that has their keys, null where there is none; `other` has a row a key at most.

    A left join as a union and a window: rows that lie together by some of the
    keys stay where they are, which a join by all keys doesn't allow. Rows with a null key
    get nothing.
    """
    mine = rows.columns
    found = F.first("_found", ignorenulls=True).over(Window.partitionBy(*keys))
    both = rows.withColumn("_mine", F.lit(True)).unionByName(other.select(*keys, F.struct(*values).alias("_found")), allowMissingColumns=True)
    both = both.withColumn("_found", found).where("_mine")
    known = F.lit(True)
    for key in keys:
        known = known & F.col(key).isNotNull()
    return both.select(*mine, *(F.when(known, F.col(f"_found.{v}")).alias(v) for v in values))
