"""Strongly connected components: trimming, min labels forward and backward, decomposition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.algorithms.components import min_label_run
from weftgraph.model import Graph
from weftgraph.operators.sort import global_rank
from weftgraph.plans.supersteps import NotConverged
from weftgraph.storage import discard, written

#: Rests of at most so many vertices are left open where the number of rounds is given.
SMALL = 3


def trim(graph: Graph, max_rounds: int = 10_000) -> DataFrame:
    """(id, trimmed): vertices that cyclic trimming removes, those left without in- or out-edges, again and again.

    Self-loops hold nothing: a vertex with no other cycle is trimmed. A round is one job over the
    edges that are left, and peels a layer on both sides.
    """
    watch = Observation()
    live = graph.edges.select("src", "dst").where("src <> dst").distinct()
    live = written(live.observe(watch, F.count("*").alias("n")), "trim")
    n = watch.get["n"]
    for _ in range(max_rounds):
        if not n:
            break
        sources, targets = live.select("src").distinct(), live.select("dst").distinct()
        watch = Observation()
        # an edge stays if something enters its source and something leaves its target
        kept = live.join(targets.select(F.col("dst").alias("src")), "src", "left_semi")
        kept = kept.join(sources.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")
        after = written(kept.observe(watch, F.count("*").alias("n")), "trim")
        before, n = n, watch.get["n"]
        discard(live)
        live = after
        if n == before:
            break
    else:
        raise NotConverged(f"still trimming after {max_rounds} rounds")
    core = live.select(F.col("src").alias("id")).intersect(live.select(F.col("dst").alias("id")))
    marked = graph.vertices.select("id").join(core.withColumn("core", F.lit(True)), "id", "left")
    return marked.select("id", F.col("core").isNull().alias("trimmed"))


def min_labels(graph: Graph) -> DataFrame:
    """(id, min_forward, min_backward): the least id that reaches a vertex; the least root (own least id) that it reaches, -1 if none."""
    forward = written(min_label_run(graph).state.withColumnRenamed("label", "min_forward"), "forward")
    roots = Graph(forward, graph.edges).reversed()
    backward = min_label_run(roots, seeds=F.col("min_forward") == F.col("id")).state
    label = F.coalesce("label", F.lit(-1)).cast("bigint").alias("min_backward")
    return forward.join(backward, "id").select("id", "min_forward", label)


def _groups(labels: DataFrame) -> DataFrame:
    return labels.groupBy("min_forward", "min_backward").agg(F.count("*").alias("n"))


def decompose(graph: Graph, labels: DataFrame, small: int = SMALL, next_color: int = 0) -> tuple[DataFrame, DataFrame, dict]:
    """(id, color, tag), the edges within one color, and {next_color, largest}.

    A color is next_color and the rank of its (min_forward, min_backward) pair. tag 1: an SCC is
    found (both equal); -1: a rest of at most `small` vertices; 0: to be split further. largest is
    the size of the greatest group that is no SCC.
    """
    colors = written(global_rank(_groups(labels), ["min_forward", "min_backward"], "color"), "colors")
    same = F.col("min_forward") == F.col("min_backward")
    facts = colors.agg(F.count("*"), F.max(F.when(~same, F.col("n")))).first()
    tag = F.when(same, 1).when(F.col("n") <= small, -1).otherwise(0)
    color = (F.col("color") + next_color).alias("color")
    found = labels.join(colors, ["min_forward", "min_backward"]).select("id", color, tag.alias("tag"))
    ends = found.select("id", "color")
    inner = graph.edges.join(ends.select(F.col("id").alias("src"), F.col("color").alias("cs")), "src")
    inner = inner.join(ends.select(F.col("id").alias("dst"), F.col("color").alias("cd")), "dst").where("cs = cd")
    return found, inner.select("src", "dst"), {"next_color": next_color + facts[0], "largest": facts[1] or 0}


def strong_components(graph: Graph, rounds: int | None = None, small: int = SMALL, max_rounds: int = 10_000) -> DataFrame:
    """(id, component): the least member of each vertex's SCC.

    Each round trims, labels and cuts all vertices without a component at once. With rounds, groups
    of at most `small` vertices that are no SCC are left open as they come up, and what is then
    unsettled, too; both get null.
    """
    vertices = written(graph.vertices.select("id"), "scc")
    live = written(graph.edges.select("src", "dst").where("src <> dst").distinct(), "scc")
    done, k = [], 0
    while rounds is None or k < rounds:
        k += 1
        if k > max_rounds:
            raise NotConverged(f"vertices without a component after {max_rounds} rounds")
        trimmed = written(trim(Graph(vertices, live)), "scc")
        done.append(trimmed.where("trimmed").select("id", F.col("id").alias("component")))
        vertices = written(trimmed.where(~F.col("trimmed")).select("id"), "scc")
        if vertices.isEmpty():
            break
        inside = live.join(vertices.select(F.col("id").alias("src")), "src", "left_semi")
        inside = written(inside.join(vertices.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"), "scc")
        labels = written(min_labels(Graph(vertices, inside)), "scc")
        equal = F.col("min_forward") == F.col("min_backward")
        done.append(labels.where(equal).select("id", F.col("min_forward").alias("component")))
        rest = labels.where(~equal)
        if rounds is not None:
            rest = written(rest.join(_groups(rest), ["min_forward", "min_backward"]), "scc")
            done.append(rest.where(F.col("n") <= small).select("id", F.lit(None).cast("bigint").alias("component")))
            rest = rest.where(F.col("n") > small)
        vertices = written(rest.select("id"), "scc")
        pair = F.struct("min_forward", "min_backward")
        a = rest.select(F.col("id").alias("src"), pair.alias("ps"))
        b = rest.select(F.col("id").alias("dst"), pair.alias("pd"))
        cut = written(inside.join(a, "src").join(b, "dst").where("ps = pd").select("src", "dst"), "scc")
        discard(live)
        discard(inside)
        live = cut
        if vertices.isEmpty():
            break
    out = vertices.select("id", F.lit(None).cast("bigint").alias("component"))
    for more in done:
        out = out.union(more)
    return out
