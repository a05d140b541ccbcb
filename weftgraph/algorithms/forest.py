"""Minimum spanning forest by Boruvka rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.model import Graph, edge_once
from weftgraph.operators.messages import request
from weftgraph.plans.supersteps import NotConverged
from weftgraph.storage import discard, written


def jump_to_roots(parents: DataFrame, lookup: bool = False, max_rounds: int = 64) -> DataFrame:
    """(id, root) from (id, parent) without cycles but roots' own; pointers double each round."""
    state = written(parents.select("id", F.col("parent").alias("root")), "jump")
    for _ in range(max_rounds):
        watch = Observation()
        up = request(state, state, "root", {"up": F.col("root")}, distinct=lookup)
        new = up.select("id", F.coalesce("up", "root").alias("root"), (F.col("up") != F.col("root")).alias("moved"))
        after = written(new.observe(watch, F.count_if("moved").alias("moved")).drop("moved"), "jump")
        discard(state)
        state = after
        if not watch.get["moved"]:
            return state
    raise NotConverged(f"pointers still move after {max_rounds} rounds")


def spanning_forest_edges(graph: Graph, lookup: bool = False, max_rounds: int = 64) -> DataFrame:
    """(u, v, weight), u < v: the forest that is unique under the order (weight, larger end, smaller end).

    Parallel edges count with their least weight, self-loops not at all. A round picks each
    component's least outgoing edge (a grouped minimum), hooks, contracts and drops inner edges.
    """
    once = edge_once(graph.edges)
    live = written(once.select("u", "v", "weight", F.col("u").alias("a"), F.col("v").alias("b")), "msf")
    picked = []
    for _ in range(max_rounds + 1):
        order = F.struct("weight", F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo"))
        both = live.select(F.col("a").alias("id"), F.col("b").alias("other"), order.alias("e")).union(live.select("b", "a", order))
        best = written(both.groupBy("id").agg(F.min(F.struct("e", "other")).alias("m")).select("id", "m.e", "m.other"), "msf")
        if best.isEmpty():
            break
        picked.append(best.select("e").distinct())
        back = best.select(F.col("id").alias("other"), F.col("other").alias("theirs"))
        # of two components that pick each other the smaller id stays a root
        hooks = best.join(back, "other", "left").select("id", F.when((F.col("theirs") == F.col("id")) & (F.col("id") < F.col("other")), F.col("id")).otherwise(F.col("other")).alias("parent"))
        roots = jump_to_roots(hooks, lookup)
        a, b = roots.select(F.col("id").alias("a"), F.col("root").alias("ra")), roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        new = live.join(a, "a").join(b, "b").where("ra <> rb").select("u", "v", "weight", F.col("ra").alias("a"), F.col("rb").alias("b"))
        after = written(new, "msf")
        discard(live)
        live = after
    else:
        raise NotConverged(f"edges between trees after {max_rounds} rounds")
    if not picked:
        return once.where("false").select("u", "v", "weight")
    every = picked[0]
    for more in picked[1:]:
        every = every.union(more)
    return every.select(F.col("e.lo").alias("u"), F.col("e.hi").alias("v"), F.col("e.weight").alias("weight"))
