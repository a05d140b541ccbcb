"""Graphs derived from whole relational tables; columns are pruned at the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.model import Graph, from_edges
from weftgraph.operators.sort import lag_in_order

#: What keeps the ids of suppliers, orders and order lines apart from those of parts and customers.
SUPPLIER, ORDER, LINE = 1_000_000_000, 10_000_000_000, 1_000_000_000_000


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def sales_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(src, dst), every edge once, and (id) of all customers."""
    orders = _read(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    lines = _read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    order = lambda key: (F.lit(ORDER) + F.col(key)).alias
    line = F.lit(LINE) + F.col("l_orderkey") * 8 + F.col("l_linenumber")
    edges = orders.select(F.col("o_custkey").alias("src"), order("o_orderkey")("dst"))
    edges = edges.union(lines.select(order("l_orderkey")("src"), line.alias("dst")))
    # hardly a row repeats: dealt first, no scan's task holds all of its rows, which grow with the files
    edges = edges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "src", "dst").distinct()
    customers = _read(spark, sf_dir, "customer", "c_custkey").select(F.col("c_custkey").alias("id"))
    return edges, customers


def sales_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected forest: every customer with all orders, every order with all its lines; customers without orders stand alone."""
    return from_edges(*sales_edges(spark, sf_dir), undirected=True)


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight), every edge once."""
    rows = _read(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber")
    weight = F.min((F.col("l_quantity") * 100 + F.col("l_linenumber")).cast("bigint")).alias("weight")
    ends = (F.col("l_partkey").alias("src"), (F.lit(SUPPLIER) + F.col("l_suppkey")).alias("dst"))
    return rows.groupBy(*ends).agg(weight).where("src is not null and dst is not null")


def supply_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected, with cycles: every part with all its suppliers, over all order lines; the weight is least of any line."""
    return from_edges(supply_edges(spark, sf_dir), undirected=True)


def _consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, event_id, before, user_id): every event but the first with the user of the one before."""
    events = _read(spark, sf_dir, "events", "ts", "event_id", "user_id")
    return lag_in_order(events, ["ts", "event_id"], "user_id", "before").where("before is not null")


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed: the user of every event -> the user of the next one, if another."""
    rows = _consecutive(spark, sf_dir).where("before <> user_id")
    return from_edges(rows.select(F.col("before").alias("src"), F.col("user_id").alias("dst")).distinct())


def visit_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed and sparse: every user -> whoever comes after its first event, and after its last one, over all events."""
    order = F.struct("ts", "event_id")
    rows = _consecutive(spark, sf_dir).groupBy(F.col("before").alias("src"))
    rows = rows.agg(F.array(F.min_by("user_id", order), F.max_by("user_id", order)).alias("next"))
    edges = rows.select("src", F.explode("next").alias("dst")).distinct()
    users = _read(spark, sf_dir, "events", "user_id").select(F.col("user_id").alias("id")).where("id is not null").distinct()
    return from_edges(edges, users)
