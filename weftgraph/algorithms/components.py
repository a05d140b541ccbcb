"""Connected components: min-label propagation, and hooking with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.model import Graph
from weftgraph.operators.messages import request, sized
from weftgraph.plans.supersteps import NotConverged, Program, Run, run
from weftgraph.storage import discard, written


def min_label_run(graph: Graph, tau: int | None = None, seeds=None, report: int = 0, max_steps: int = 10_000) -> Run:
    """Label of a vertex: the least id that reaches it along edges. Only improved vertices send.

    seeds: a condition on vertices; only these start with a label (their id), others with null.
    """
    first = F.col("id") if seeds is None else F.when(seeds, F.col("id"))
    better = F.col("label").isNotNull() & ~F.col("label").eqNullSafe(F.col("old_label"))
    program = Program(
        initial={"label": first},
        compute=lambda c: {} if c.step == 1 else {"label": F.least("label", "msg_label")},
        message={"label": F.col("label")},
        combine={"label": F.min("label")},
        send=lambda c: F.col("label").isNotNull() if c.step == 1 else better,
    )
    return run(graph, program, tau=tau, report=report, max_steps=max_steps)


def hash_min(graph: Graph, tau: int | None = None, max_steps: int = 10_000) -> DataFrame:
    """(id, component); tau mirrors vertices of that degree or more, with the same result."""
    return min_label_run(graph, tau, max_steps=max_steps).state.select("id", F.col("label").alias("component"))


def keeping_adjacency(graph: Graph) -> DataFrame:
    """(id, color, nbr): every edge with the component of its source; a vertex without edges has one row, nbr null."""
    colors = hash_min(graph).withColumnRenamed("component", "color")
    near = graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr"))
    return colors.join(near, "id", "left").select("id", "color", "nbr")


def _counted(df: DataFrame, name: str, **counts) -> tuple[DataFrame, dict]:
    watch = Observation()
    return written(df.observe(watch, *[c.alias(n) for n, c in counts.items()]), name), watch.get


def _jumped(pointers: DataFrame, n: int, lookup: bool, max_rounds: int) -> DataFrame:
    """(id, d) with d moved to the root of its tree; pointers: (id, d), n of them, of all vertices but the roots.

    Only pointers that have moved ask again: one whose target points nowhere is at the root.
    """
    state, open_ = pointers.withColumn("open", F.lit(True)), n
    for _ in range(max_rounds):
        answers, still = state.select("id", "d"), state.where("open")
        asked = request(sized(still, open_), answers, "d", {"dd": F.col("d")}, distinct=lookup)
        new = asked.select("id", F.coalesce("dd", "d").alias("d"), F.col("dd").isNotNull().alias("open"))
        after, got = _counted(new.unionByName(state.where("not open")), "jump", open=F.count_if("open"))
        discard(state)
        state, open_ = after, got["open"]
        if not open_:
            return state.select("id", "d")
    raise NotConverged(f"pointers still move after {max_rounds} rounds")


def hooked(links: DataFrame, star_hook: bool = False, lookup: bool = False, max_rounds: int = 64) -> DataFrame:
    """(id, d), d the least id of the component, of all vertices but those that are it. links: (hi, lo), hi > lo.

    In a round every vertex hooks onto its least smaller neighbour, so trees come about without
    cycles; pointers jump to the roots, and the links are drawn between these. Where there are no
    more links than hooks all of them have been used up. star_hook lets those that hooked nowhere
    hook onto the least label that a neighbour has just taken (fewer rounds where roots have many
    links, a join more); lookup asks for a pointer's pointer once a distinct pointer.
    """
    done: DataFrame | None = None
    for _ in range(max_rounds):
        least = links.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("d"), F.count("*").alias("n"))
        hooks, got = _counted(least, "hooks", hooks=F.count("*"), links=F.sum("n"))
        n, rest = got["hooks"], (got["links"] or 0) - got["hooks"]
        if not n:
            break
        hooks = hooks.select("id", "d")
        if star_hook and rest:
            near = links.join(sized(hooks, n), F.col("id") == F.col("hi")).where("d < lo")
            near = near.groupBy(F.col("lo").alias("id")).agg(F.min("d").alias("d"))
            near = near.join(sized(hooks.select("id"), n), "id", "left_anti")
            hooks, got = _counted(hooks.unionByName(near), "hooks", hooks=F.count("*"))
            n = got["hooks"]
        roots = _jumped(hooks, n, lookup, max_rounds)
        if done is not None:  # roots of earlier rounds have hooked in this one
            up = roots.select(F.col("id").alias("d"), F.col("d").alias("dd"))
            done = done.join(sized(up, n), "d", "left").select("id", F.coalesce("dd", "d").alias("d")).unionByName(roots)
            done = written(done, "roots")
        else:
            done = roots
        if not rest:
            break
        a = sized(roots.select(F.col("id").alias("hi"), F.col("d").alias("a")), n)
        b = sized(roots.select(F.col("id").alias("lo"), F.col("d").alias("b")), n)
        ends = links.join(a, "hi").join(b, "lo", "left").select("a", F.coalesce("b", "lo").alias("b"))
        left = ends.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        links = written(left.distinct(), "links")
    else:
        raise NotConverged(f"trees still hook after {max_rounds} rounds")
    return done if done is not None else links.select(F.col("hi").alias("id"), F.col("lo").alias("d")).where("false")


def pointer_jumping(graph: Graph, star_hook: bool = False, lookup: bool = False, max_rounds: int = 64) -> DataFrame:
    """(id, component) of an undirected graph by hooking and jumping, see ``hooked``. All forms give the least id."""
    links = graph.edges.where("src > dst").select(F.col("src").alias("hi"), F.col("dst").alias("lo"))
    found = hooked(links, star_hook, lookup, max_rounds)
    own = graph.vertices.select("id").join(found.hint("merge"), "id", "left")
    return own.select("id", F.coalesce("d", "id").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def message_report(graph: Graph, workers: int = 0) -> DataFrame:
    """(step, n_messages) of min-label propagation: messages after combining that were delivered in each step.

    With workers, (step, worker, n_messages) by that many hash partitions of the targets.
    """
    steps = min_label_run(graph, report=workers).steps
    spark = graph.vertices.sparkSession
    if workers:
        rows = [(s["step"], w, s["workers"].get(w, 0)) for s in steps for w in range(workers)]
        return spark.createDataFrame(rows, "step long, worker long, n_messages long")
    return spark.createDataFrame([(s["step"], s["received"]) for s in steps], "step long, n_messages long")
