"""PageRank, shortest paths and field broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.model import Graph
from weftgraph.operators.messages import along_edges, push, request
from weftgraph.plans.supersteps import Context, Program, run
from weftgraph.storage import written


def page_rank(graph: Graph, updates: int = 10, tau: int | None = None, damping: float = 0.85) -> DataFrame:
    """(id, rank) after a fixed number of updates; parallel edges count, dangling mass is shared by all.

    What is sent to a missing vertex is lost.
    """
    ranked = Graph(written(graph.degrees(), "degrees"), graph.edges)
    dangling = F.sum(F.when((F.col("degree") == 0) & F.col("__on"), F.col("rank")))

    def compute(c: Context) -> dict[str, Column]:
        if c.step == 1:
            return {"rank": F.lit(1.0 / c.vertices)}
        spread = (c.aggregates["dangling"] or 0.0) / c.vertices
        base = F.lit((1 - damping) / c.vertices)
        return {"rank": base + damping * (F.coalesce("msg_share", F.lit(0.0)) + F.lit(spread))}

    program = Program(
        initial={"rank": F.lit(0.0), "degree": F.col("degree")},
        compute=compute,
        message={"share": F.col("rank") / F.col("degree")},
        combine={"share": F.sum("share")},
        send=lambda c: (F.col("degree") > 0) & F.lit(c.step <= updates),
        stay_active=lambda c: F.lit(c.step <= updates),
        aggregates={"dangling": dangling},
    )
    return run(ranked, program, tau=tau).state.select("id", "rank")


def shortest_paths(graph: Graph, source: int, tau: int | None = None, weighted: bool = False) -> DataFrame:
    """(id, dist, prev) from source; unreached: null, null; the source's prev is -1.

    Ties go to the least predecessor. weights must be positive; a candidate is taken only if
    strictly shorter, so with weights prev is settled at the end from the final distances.
    """
    step = F.col("weight").cast("double") if weighted else F.lit(1.0)
    program = Program(
        initial={"dist": F.when(F.col("id") == source, F.lit(0.0)), "prev": F.when(F.col("id") == source, F.lit(-1).cast("bigint"))},
        compute=lambda c: {} if c.step == 1 else _nearer(),
        message={"way": F.struct((F.col("dist") + step).alias("dist"), F.col("id").alias("by"))},
        combine={"way": F.min("way")},
        send=lambda c: F.col("dist").isNotNull() if c.step == 1 else F.col("dist").isNotNull() & ~F.col("dist").eqNullSafe(F.col("old_dist")),
    )
    found = run(graph, program, tau=tau).state
    if not weighted:
        return found
    before = found.where("dist is not null").select("id", "dist")
    ways = along_edges(before, graph.edges).select("dst", F.col("id").alias("by"), (F.col("dist") + step).alias("d"))
    last = ways.join(found.select(F.col("id").alias("dst"), F.col("dist").alias("final")), "dst").where("d = final").groupBy(F.col("dst").alias("id")).agg(F.min("by").alias("by"))
    return found.join(last, "id", "left").select("id", "dist", F.when(F.col("id") == source, F.lit(-1).cast("bigint")).when(F.col("dist").isNotNull(), F.col("by")).alias("prev"))


def _nearer() -> dict[str, Column]:
    better = F.col("msg_way").isNotNull() & (F.col("dist").isNull() | (F.col("msg_way.dist") < F.col("dist")))
    return {"dist": F.when(better, F.col("msg_way.dist")).otherwise(F.col("dist")), "prev": F.when(better, F.col("msg_way.by")).otherwise(F.col("prev"))}


def field_broadcast(graph: Graph, fields: DataFrame, directed: bool = True, lookup: bool = False, default: int | None = None) -> DataFrame:
    """(id, nbr, field): each vertex with its neighbours' fields. fields: (id, field).

    Directed: out-neighbours. Undirected: those that point here (the same on symmetric edges).
    lookup asks each distinct neighbour once; a neighbour without a field gives null, or default.
    """
    ends = ("src", "dst") if directed else ("dst", "src")
    asks = graph.edges.select(F.col(ends[0]).alias("id"), F.col(ends[1]).alias("nbr"))
    return request(asks, fields, "nbr", {"field": F.col("field")}, {"field": default} if default is not None else None, distinct=lookup).select("id", "nbr", "field")


def field_pushed(graph: Graph, fields: DataFrame, default: int | None = None) -> DataFrame:
    """(id, nbr, field): out-neighbours with the field that they have pushed here along an edge of their own, else the default.

    The same as field_broadcast on symmetric edges; nothing is asked for.
    """
    told = push(graph.edges.select(F.col("dst").alias("id"), F.col("src").alias("by")), fields, {"field": F.col("field")})
    asks = graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr"))
    out = asks.join(told.withColumnRenamed("by", "nbr"), ["id", "nbr"], "left")
    return out.select("id", "nbr", F.coalesce("field", F.lit(default)).alias("field") if default is not None else "field")
