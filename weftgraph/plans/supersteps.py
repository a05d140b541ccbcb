"""The fixpoint driver: vertex programs as one DataFrame plan a superstep.

A program is made of Column expressions. In each step the states meet their combined messages,
eligible vertices (active, or with a message, or all when woken) are updated, and what was computed
is written; counts and aggregators are observed by that same job. Messages are derived from what a
step has written at the start of the next plan, so a step is one job. Only aggregator values and
counts reach the driver.

A step in which few vertices can be eligible writes these only: the state is a written table and up
to ``DELTAS`` tables of changes, merged when there are more. So a frontier of a few vertices costs a
scan of the state, not a shuffle and a rewrite of it. Lineage ends at each written table, and tables
of past steps are deleted.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.metrics import log
from weftgraph.model import Graph
from weftgraph.operators.messages import combine, sized
from weftgraph.storage import discard, written

#: Tables of changes that a state may have before it is merged.
DELTAS = 3


class NotConverged(RuntimeError):
    """A loop has reached its limit of rounds before its fixpoint."""


@dataclass
class Context:
    """What a program may know in a step: its number (from 1) and phase, vertex counts, and the aggregates of the step before."""

    step: int
    phase: int
    vertices: int
    active: int
    aggregates: dict[str, Any]
    groups: dict[str, DataFrame] = field(default_factory=dict)  # (key, n) of each count map of the step before
    flags: dict[str, Any] = field(default_factory=dict)  # the program's own control bits


@dataclass
class Program:
    """initial: state columns over the vertices. compute: new state columns over state and messages.

    stay_active and send are over the new state (old values as old_<name>); message columns are over
    the sender's state and the edge. combine folds message columns by target. aggregates run over
    computed vertices with their new state; groups counts them by a key each. control returns None,
    "terminate" or "wake" for the step to come. add gives vertices to add after a step, messages
    gives messages to any id (dst, columns) besides those along edges; both get the rows that the
    last step has written. In aggregates ``__on`` marks computed vertices.
    """

    initial: dict[str, Column]
    compute: Callable[[Context], dict[str, Column]]
    message: dict[str, Column] = field(default_factory=dict)
    combine: dict[str, Column] = field(default_factory=dict)
    send: Callable[[Context], Column] = lambda c: F.lit(True)
    stay_active: Callable[[Context], Column] = lambda c: F.lit(False)
    aggregates: dict[str, Column] = field(default_factory=dict)
    groups: dict[str, Column] = field(default_factory=dict)
    control: Callable[[Context], str | None] = lambda c: None
    add: Callable[[Context, DataFrame], DataFrame | None] = lambda c, state: None
    messages: Callable[[Context, DataFrame, Graph], DataFrame | None] | None = None


@dataclass
class Run:
    """The final state, and by step: phase, step, computed, active, sent, received, added, mirrored, seconds.

    received counts the messages after combining that found their vertex; mirrored the states that
    went out by mirrors (None unless reported); workers has received by hash partition, if reported.
    """

    state: DataFrame
    steps: list[dict]


class _State:
    """A table of all vertices and tables of changes to it, the latest last."""

    def __init__(self, table: DataFrame, columns: list[str]):
        self.base, self.changes, self.columns = table, [], columns
        self.sizes: list[int] = []  # rows of the changes
        self.own = False  # whether base is a table of this run: the caller's vertices are not deleted

    def rows(self) -> DataFrame:
        out = self.base.select(*self.columns)
        for change, n in zip(self.changes, self.sizes, strict=True):
            out = out.join(sized(change.select("id"), n), "id", "left_anti").unionByName(change.select(*self.columns))
        return out

    def replace(self, table: DataFrame) -> None:
        old = [*([self.base] if self.own else []), *self.changes]
        self.base, self.changes, self.sizes, self.own = table, [], [], True
        for t in old:
            discard(t)

    def change(self, table: DataFrame, n: int) -> list[DataFrame]:
        """Adds a table of n changes; returns tables that are no longer part of the state but by that table."""
        self.changes.append(table)
        self.sizes.append(n)
        if len(self.changes) <= DELTAS:
            return []
        old = [*([self.base] if self.own else []), *self.changes[:-1]]
        self.base, self.changes, self.sizes, self.own = written(self.rows(), "state"), [], [], True
        for t in old:
            discard(t)
        return [table]


def run(
    graph: Graph,
    program: Program,
    phases: int = 1,
    tau: int | None = None,
    max_steps: int = 10_000,
    report: int = 0,
) -> Run:
    """Runs the program until no vertex is active and none has sent, or it terminates itself.

    More than max_steps in a phase raise NotConverged. With report, messages are also counted by
    that many hash partitions of their targets, at the price of a job a step.
    """
    values = list(program.initial)
    edges = graph.spread(tau) if program.message else None
    first = graph.vertices.select("id", *[c.alias(n) for n, c in program.initial.items()])
    state = _State(first.withColumn("active", F.lit(True)), ["id", *values, "active"])
    steps: list[dict] = []
    vertices = active = graph.vertices.count()
    aggregates: dict[str, Any] = {}
    groups: dict[str, DataFrame] = {}
    flags: dict[str, Any] = {}
    last, spent = None, []  # what the last step has written; tables only that is made of
    for phase in range(1, phases + 1):
        step, wake, sent = 0, True, 0
        while True:
            begin = time.perf_counter()
            step += 1
            context = Context(step, phase, vertices, active, aggregates, groups, flags)
            if step > 1:
                order = program.control(context)
                if order == "terminate":
                    break
                wake = order == "wake"
                if not wake and not active and not sent:
                    break
            if step > max_steps:
                raise NotConverged(f"not at a fixpoint after {max_steps} supersteps")
            combined, mirrored = None, None
            if step > 1 and program.combine and sent:
                senders = last.where("sends").select("id", *values)
                rows = edges.along(senders, sent) if program.message else None
                if rows is not None:
                    rows = rows.select("dst", *[c.alias(n) for n, c in program.message.items()])
                if program.messages is not None:
                    other = program.messages(context, last, graph)
                    rows = other if rows is None else rows if other is None else rows.unionByName(other)
                combined = combine(rows, **{f"msg_{n}": c for n, c in program.combine.items()})
                combined = combined.withColumn("__got", F.lit(True))
                if program.messages is None:
                    combined = sized(combined, sent * edges.most)
                mirrored = edges.mirrored(senders) if report and program.message else None
            every = wake or active >= vertices or 4 * (active + sent) > vertices
            joined = _eligible(state.rows(), combined, program, every, wake, active)
            picked = _computed(joined, program, context, values)
            watch = Observation()
            counts = [
                F.count_if("__on").alias("computed"),
                F.count_if("active").alias("active"),
                F.count_if("sends").alias("sent"),
                F.count_if("__got").alias("received"),
                F.count("*").alias("rows"),
                *(c.alias(f"agg_{n}") for n, c in program.aggregates.items()),
            ]
            table = written(picked.observe(watch, *counts), "step")
            got = watch.get
            for t in spent:
                discard(t)
            if every:
                state.replace(table)
                spent = []
            else:
                spent = state.change(table, got["rows"])
            last = table
            new_rows = program.add(context, last)
            added = _add(state, new_rows, values) if new_rows is not None else 0
            sent, active, vertices = got["sent"], got["active"] + added, (got["rows"] if every else vertices) + added
            aggregates = {n: got[f"agg_{n}"] for n in program.aggregates}
            groups = {n: _counted(last, key, n) for n, key in program.groups.items()}
            entry = {"phase": phase, "step": step, "computed": got["computed"], "active": got["active"], "sent": sent}
            entry |= {"received": got["received"], "added": added, "mirrored": mirrored}
            if report:
                part = F.pmod(F.hash("id"), F.lit(report)).alias("worker")
                found = last.where("__got").groupBy(part).agg(F.count("*").alias("n")).collect()
                entry["workers"] = {r["worker"]: r["n"] for r in found}  # at most `report` rows
            entry["seconds"] = round(time.perf_counter() - begin, 3)
            log(f"phase {phase} step {step}: {entry}")
            steps.append(entry)
    graph.release()
    return Run(state.rows().select("id", *values), steps)


def _eligible(state: DataFrame, combined: DataFrame | None, program: Program, every: bool, wake: bool, active: int) -> DataFrame:
    """The rows that a step looks at with their messages; all of them if every is set, marked in __on if they are computed."""
    if combined is None:
        nothing = {f"msg_{n}": F.lit(None) for n in program.combine}
        joined = state.withColumns({**nothing, "__got": F.lit(False)})
    else:
        # without an active vertex those with messages are all there are: the smaller side may be broadcast
        joined = state.join(combined, "id", "left" if every or active else "inner")
        joined = joined.withColumn("__got", F.coalesce("__got", F.lit(False)))
    joined = joined.withColumn("__on", F.lit(True) if wake else F.col("active") | F.col("__got"))
    return joined if every else joined.where("__on")


def _computed(joined: DataFrame, program: Program, context: Context, values: list[str]) -> DataFrame:
    """(id, values, active, sends, __on, __got) after the program's compute."""
    new = program.compute(context)
    old = [F.col(v).alias(f"old_{v}") for v in values]
    now = [(F.when(F.col("__on"), new[v]).otherwise(F.col(v)) if v in new else F.col(v)).alias(v) for v in values]
    changed = joined.select("id", "__on", "__got", *old, *now)
    flags = {"active": F.col("__on") & program.stay_active(context), "sends": F.col("__on") & program.send(context)}
    return changed.withColumns(flags).select("id", *values, "active", "sends", "__on", "__got")


def _add(state: _State, new_rows: DataFrame, values: list[str]) -> int:
    """Adds vertices that are not there yet; they start active. Returns their number."""
    fresh = new_rows.dropDuplicates(["id"]).join(state.rows().select("id"), "id", "left_anti")
    watch = Observation()
    fresh = fresh.select("id", *values).withColumn("active", F.lit(True))
    table = written(fresh.observe(watch, F.count("*").alias("n")), "added")
    n = watch.get["n"]
    state.base, state.changes, state.sizes, state.own = written(state.rows().unionByName(table), "state"), [], [], True
    return n


def _counted(last: DataFrame, key: Column, name: str) -> DataFrame:
    """(key, n): computed vertices by key; a table to join, whatever the number of keys."""
    return written(last.where("__on").groupBy(key.alias("key")).agg(F.count("*").alias("n")), name)
