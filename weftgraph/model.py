"""Graphs as a vertex table and an edge table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.messages import Spread, spread


@dataclass
class Graph:
    """vertices(id, ...) and edges(src, dst[, weight]); an undirected graph has a row in each direction.

    ``spread()`` gives the edges persisted, partitioned by source but for those of hubs, which are
    dealt over all partitions: every superstep joins them where they lie and only the states move.
    loose, where it is known, holds (id), repeated or not, of all vertices that are no edge's source.
    """

    vertices: DataFrame
    edges: DataFrame
    loose: DataFrame | None = None
    _cached: dict = field(default_factory=dict, repr=False)

    def spread(self, tau: int | None = None) -> Spread:
        if tau not in self._cached:
            self._cached[tau] = spread(self.edges, tau)
        return self._cached[tau]

    def release(self) -> None:
        for own in self._cached.values():
            own.release()
        self._cached.clear()

    def degrees(self) -> DataFrame:
        """(id, degree): out-edges of every vertex, parallel ones counted, 0 for none."""
        if self.loose is not None:  # the vertices come up with the counts
            n = lambda k: F.lit(k).cast("bigint").alias("n")
            rows = self.edges.select(F.col("src").alias("id"), n(1)).union(self.loose.select("id", n(0)))
            return rows.groupBy("id").agg(F.sum("n").alias("degree"))
        out = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        degree = F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree")
        return self.vertices.select("id").join(out, "id", "left").select("id", degree)

    def reversed(self) -> Graph:
        names = [c for c in self.edges.columns if c not in ("src", "dst")]
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *names))


def from_edges(edges: DataFrame, vertices: DataFrame | None = None, undirected: bool = False, strict: bool = False) -> Graph:
    """A graph from (src, dst[, weight]); undirected adds the other direction.

    Endpoints missing from vertices are added unless strict; then edges may lead nowhere, and what
    is sent along them is dropped. Rows with a null endpoint are no edges.
    """
    edges = edges.where("src is not null and dst is not null")
    if undirected:
        names = [c for c in edges.columns if c not in ("src", "dst")]
        ends = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst")) for a, b in (("src", "dst"), ("dst", "src"))]
        edges = edges.select(F.explode(F.array(*ends)).alias("e"), *names).select("e.src", "e.dst", *names)
        ends = edges.select(F.col("src").alias("id"))
    else:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    if vertices is None:
        return Graph(ends.distinct(), edges)
    if strict:
        return Graph(vertices, edges)
    if vertices.columns == ["id"]:
        return Graph(vertices.union(ends).distinct(), edges, vertices if undirected else vertices.union(edges.select("dst")))
    return Graph(vertices.unionByName(ends.distinct().join(vertices.select("id"), "id", "left_anti"), allowMissingColumns=True), edges)


def merged(*graphs: Graph) -> Graph:
    """One graph of several inputs: all vertices once, all edges; columns that one lacks are null."""
    vertices, edges = graphs[0].vertices.select("id"), graphs[0].edges
    loose = [g.vertices.select("id") if g.loose is None else g.loose for g in graphs]
    for g in graphs[1:]:
        vertices = vertices.unionByName(g.vertices.select("id"))
        edges = edges.unionByName(g.edges, allowMissingColumns=True)
    for more in loose[1:]:
        loose[0] = loose[0].union(more)
    return Graph(vertices.distinct(), edges, loose[0])


def edge_once(edges: DataFrame) -> DataFrame:
    """Simple undirected edges (u < v) with the least weight of parallel ones; self-loops are dropped."""
    ends = [F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")]
    if "weight" in edges.columns:
        return edges.where("src <> dst").groupBy(*ends).agg(F.min("weight").alias("weight"))
    return edges.where("src <> dst").select(*ends).distinct()
