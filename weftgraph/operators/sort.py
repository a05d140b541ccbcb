"""Distributed sort: range partitions by sampled splitters, sorted locally, and positions in the global order.

Nothing passes through one task: each range partition is numbered by itself and shifted by what
the partitions before it hold, of which there is one row a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.storage import written


def ranged(df: DataFrame, keys: list[str], partitions: int | None = None) -> DataFrame:
    """df sorted by keys, with the number of its range partition in __part, written once so that it stays."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()), "sort")


def sort_global(df: DataFrame, keys: list[str]) -> DataFrame:
    """df in global order; ties need further keys to be in a defined one."""
    return df.orderBy(*keys)


def global_rank(df: DataFrame, keys: list[str], name: str = "rank") -> DataFrame:
    """df with its position in the order of keys, from 0."""
    parts = ranged(df, keys)
    counts = parts.groupBy("__part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "before")  # a row a partition
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return parts.withColumn("__row", local).join(F.broadcast(before), "__part").withColumn(name, (F.col("before") + F.col("__row") - 1).cast("bigint")).drop("__part", "__row", "before")


def lag_in_order(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """df with the value of the row before it in the global order of keys; null for the first."""
    parts = ranged(df, keys)
    last = parts.groupBy("__part").agg(F.max_by(F.struct(value), F.struct(*keys)).alias("last"))
    edge = last.select("__part", F.lag("last").over(Window.orderBy("__part")).alias("__edge"))  # a row a partition
    own = Window.partitionBy("__part").orderBy(*keys)
    rows = parts.withColumns({"__lag": F.lag(value).over(own), "__first": F.row_number().over(own) == 1}).join(F.broadcast(edge), "__part")
    return rows.withColumn(name, F.when(F.col("__first"), F.col("__edge")[value]).otherwise(F.col("__lag"))).drop("__part", "__lag", "__first", "__edge")


def tera_sort(items: DataFrame, prefix: bool = False) -> DataFrame:
    """items(key, content) in order of (key, content); prefix puts the global rank before the content."""
    if not prefix:
        return sort_global(items.select("key", "content"), ["key", "content"])
    ranked = global_rank(items.select("key", "content"), ["key", "content"])
    return ranked.select("key", F.concat_ws(" ", F.col("rank").cast("string"), "content").alias("content"), "rank")
