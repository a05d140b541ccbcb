"""Connected components by alternating star contraction.

Large-star and small-star rounds (Kiveris et al., 2014) shorten every path to the component's
smallest id in about log(diameter) rounds. Each round is a grouped minimum (partial aggregation
before the shuffle, so a hub costs one row per task) and an equi-join that AQE may split by skew;
no component is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.supersteps import NotConverged
from weftgraph.storage import discard, materialize


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(id, component) for every endpoint of edges; component is the smallest reachable id.

    Edges count as undirected. Rows with a null endpoint are ignored, a self-loop makes its
    vertex known, repeated edges change nothing, no edges give no rows.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    current = materialize(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    seen = _signature(current)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = current.union(current.select("v", "u"))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        small = low.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        small = materialize(small, "stars")
        discard(current)
        discard(large)
        current, before = small, seen
        seen = _signature(current)
        if seen == before:
            break
    else:
        raise NotConverged(f"no stars yet after {max_rounds} rounds")
    stars = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.distinct().join(stars, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
