"""What moves between vertices: messages along edges, combined on the way, and lookups by id."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of states that may be broadcast, by their number and width; of mirrored ones more are salted.
BROADCAST = 16 << 20
#: More hubs than this are not mirrored by a given tau, but from ``HUB`` on.
MIRRORS = 250_000
SALTS = 16
#: Out-edges from which a vertex is a hub, whatever the number of partitions.
HUB = 20_000
_WIDTH = {T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4, T.DoubleType: 8}


def row_bytes(schema: T.StructType) -> int | None:
    """Bytes of a row's values; None if a type has no fixed width."""
    total = 0
    for f in schema.fields:
        own = row_bytes(f.dataType) if isinstance(f.dataType, T.StructType) else _WIDTH.get(type(f.dataType))
        if own is None:
            return None
        total += own + 8
    return total


def sized(states: DataFrame, n: int | None) -> DataFrame:
    """states as a side of a join: broadcast if n of them are small, else sorted and merged, whatever their files take."""
    width = row_bytes(states.schema)
    return F.broadcast(states) if n is not None and width is not None and width * n <= BROADCAST else states.hint("merge")


@dataclass
class Spread:
    """Edges split once: those of ordinary vertices, partitioned by source, and those of hubs, dealt over all partitions."""

    cold: DataFrame
    hot: DataFrame | None = None
    hubs: DataFrame | None = None  # (id)
    n_hubs: int = 0
    most: int = 0  # out-edges of a vertex
    total: int = 0  # of all
    sources: int = 0

    def along(self, states: DataFrame, n: int | None = None) -> DataFrame:
        """states joined to their out-edges (by id = src); the rows do not depend on the split.

        States of hubs reach their edges without a shuffle of these: by broadcast where their
        number and width prove it small, over salted keys beyond that. n: how many states there are.
        """
        rows = sized(states, n).join(self.cold, F.col("id") == F.col("src"))
        if self.hot is None:
            return rows
        own = states.join(sized(self.hubs, self.n_hubs), "id", "left_semi")
        width = row_bytes(states.schema)
        if width is not None and width * self.n_hubs <= BROADCAST:
            return rows.unionByName(F.broadcast(own).join(self.hot, F.col("id") == F.col("src")))
        salted = self.hot.withColumn("__salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int"))
        copies = own.withColumn("__salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        on = (F.col("id") == F.col("src")) & (copies["__salt"] == salted["__salt"])
        return rows.unionByName(copies.hint("merge").join(salted, on).drop("__salt"))

    def mirrored(self, states: DataFrame) -> int:
        """How many of the states go out by mirrors."""
        return 0 if self.hubs is None else states.join(self.hubs, "id", "left_semi").count()

    def release(self) -> None:
        for df in (self.cold, self.hot):
            if df is not None:
                df.unpersist()


def spread(edges: DataFrame, tau: int | None = None, persist: bool = True) -> Spread:
    """edges split at degree tau; without it at a quarter of a partition's even share, ``HUB`` at least.

    So are they with tau if it makes over ``MIRRORS`` hubs: their states are too many to be sent to
    every task, and a copy pays only where it serves many edges.
    """
    if tau is not None and tau < 1:
        raise ValueError("tau must be at least 1")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    degrees = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    hub = F.col("degree") >= (HUB if tau is None else tau)
    total, most, n, sources = degrees.agg(F.sum("degree"), F.max("degree"), F.count_if(hub), F.count("*")).first()
    facts = {"most": most or 0, "total": total or 0, "sources": sources}
    if tau is None or n > MIRRORS:
        tau = max(HUB, (total or 0) // (4 * parts), tau or 0)
    n = int((most or 0) >= tau)
    keep = (lambda df: df.sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)) if persist else (lambda df: df)
    if n:
        hubs = degrees.where(F.col("degree") >= tau).select("id").persist(StorageLevel.MEMORY_AND_DISK)
        n = hubs.count()
    if not n:
        return Spread(keep(edges.repartition(parts, "src") if persist else edges), **facts)
    ids = sized(hubs.withColumnRenamed("id", "src"), n)
    cold, hot = edges.join(ids, "src", "left_anti"), edges.join(ids, "src", "left_semi")
    if persist:
        cold, hot = cold.repartition(parts, "src"), hot.repartition(parts, "src", "dst")
    return Spread(keep(cold.select(*edges.columns)), keep(hot.select(*edges.columns)), hubs, n, **facts)


def along_edges(states: DataFrame, edges: DataFrame, tau: int | None = None) -> DataFrame:
    """states joined to their out-edges once (by id = src); with tau, vertices of that degree or more are mirrored."""
    if tau is None:
        return states.join(edges, F.col("id") == F.col("src"))
    return spread(edges, tau, persist=False).along(states)


def combine(messages: DataFrame, to: str = "dst", **how: Column) -> DataFrame:
    """Messages folded by target: partial aggregation before the shuffle does what a combiner does."""
    return messages.groupBy(F.col(to).alias("id")).agg(*[c.alias(name) for name, c in how.items()])


def deliver(states: DataFrame, combined: DataFrame) -> DataFrame:
    """states with their messages; messages to ids that do not exist are dropped, states without any stay."""
    return states.join(combined, "id", "left")


def request(
    requests: DataFrame,
    states: DataFrame,
    target: str,
    respond: dict[str, Column],
    default: dict | None = None,
    distinct: bool = False,
) -> DataFrame:
    """requests with what their target vertex responds: an equi-join on the target's id.

    respond: name -> Column over the target's state. A missing target gives null, or the default.
    distinct asks once a target first, which pays where requests repeat much.
    """
    answers = states.select(F.col("id").alias("__target"), *[c.alias(n) for n, c in respond.items()])
    if distinct:
        asked = requests.select(F.col(target).alias("__target")).where("__target is not null").distinct()
        answers = asked.join(answers, "__target")
    out = requests.join(answers, F.col(target) == F.col("__target"), "left").drop("__target")
    for name, value in (default or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def push(pushes: DataFrame, states: DataFrame, respond: dict[str, Column]) -> DataFrame:
    """(id, by, answers): what vertices tell without being asked. pushes: (by, id), by tells id; repeated ones count once.

    Pushes by vertices that do not exist tell nothing.
    """
    answers = states.select(F.col("id").alias("by"), *[c.alias(n) for n, c in respond.items()])
    return pushes.select("id", "by").distinct().join(answers, "by").select("id", "by", *respond)


def request_counts(requests: DataFrame, states: DataFrame, target: str) -> DataFrame:
    """One row (asked, requests, responses, has_responses): all asks, different targets, and those that exist."""
    asked = requests.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("id")).agg(F.count("*").alias("n"))
    known = states.select("id").distinct().withColumn("__known", F.lit(True))
    out = asked.join(known, "id", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("asked"), F.count("*").alias("requests"), F.count("__known").alias("responses")
    )
    return out.withColumn("has_responses", F.col("responses") > 0)
