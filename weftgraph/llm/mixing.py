"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources. Documents are aggregated by membership pattern, the
only thing the driver sees: a row a pattern, whatever their number. Patterns that no source
connects are independent, so the flow is solved part by part, and a part of one pattern and one
source, such as disjoint sources give, needs no search. Tables of patterns are broadcast up to
``SMALL`` rows and joined by a shuffle beyond.

Targets: sources share the whole size by weight, none above ``repeats`` times its own size, what
is cut is shared anew. A min-cost flow routes each pattern's tokens to its sources' quotas; a
pattern's k-th pass over its documents costs k - 1 a token, so repetition is spread evenly
(convex). A pattern's flow is whole passes over all its documents plus a rest, which seeded
selection fills: documents in order of a seeded 64-bit hash up to a threshold, found digit by
digit from histograms of 4096 buckets (one small aggregation a digit, no sort). The document that
does not fit is skipped, and the order goes on from it over documents no larger than what is still
missing, until none is left that fits; then those that fit get one more pass, never beyond
``repeats``. What is still missing is less than any document with a pass to give; one document, the
nearest in size, may overshoot it.

A null text has size 0; a document of size 0 is never taken. A null source is a source of its
own, ordered last; an empty list of sources belongs to none and is never taken. Ties and repeated
rows: equal (id, size) have equal hashes; a threshold that would split them is resolved by the
row number, and as such rows are alike the result is the same at any order. Reruns agree.
A source without a weight where weights are given has weight 0, and so target 0. An empty table
gives no rows; a text of any length is counted whole. Only the id, the text, the sources and the
columns to keep are read, so other columns may have any name.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.common import materialize

DIGIT = 12
#: Rows up to which a table of patterns is broadcast.
SMALL = 20_000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than blank and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def quotas(sizes: dict, weights: dict, total: int, repeats: int = 3) -> dict:
    """Targets by water-filling: the total shared by weight, capped at repeats times a source's size."""
    out, open_ = {s: 0.0 for s in sizes if not weights.get(s)}, {s for s in sizes if weights.get(s)}
    rest = float(total)
    while open_:
        weight = sum(weights[s] for s in sorted(open_, key=str))
        above = [s for s in open_ if rest * weights[s] / weight > repeats * sizes[s]]
        if not above:
            out |= {s: rest * weights[s] / weight for s in open_}
            break
        for s in above:
            out[s] = float(repeats * sizes[s])
            open_.discard(s)
        rest = total - sum(out.values())
    return out


def connected(members: dict) -> list[list]:
    """The patterns (keys of members) in parts that have no source in common."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p, sources in members.items():
        for s in sources:
            root[find(("s", s))] = find(("p", p))
    parts: dict = {}
    for p in members:
        parts.setdefault(find(("p", p)), []).append(p)
    return list(parts.values())


def route(capacity: dict, members: dict, quota: dict, repeats: int = 3) -> dict:
    """Words from each pattern at least total cost, part by part."""
    out = dict.fromkeys(capacity, 0)
    for part in connected({p: members[p] for p in capacity}):
        asked = {s: quota[s] for p in part for s in members[p]}
        if len(part) == 1:  # all its quotas may be filled from it, as far as it reaches
            out[part[0]] = min(repeats * capacity[part[0]], sum(asked.values()))
            continue
        flow = min_cost_flow({p: capacity[p] for p in part}, {p: members[p] for p in part}, asked, repeats)
        for (p, _), f in flow.items():
            out[p] += f
    return out


def min_cost_flow(capacity: dict, members: dict, quota: dict, repeats: int = 3) -> dict:
    """Words from each (pattern, source), at least total cost; all arguments by small integers.

    capacity: size of a pattern; members: its sources; quota: whole words a source asks for.
    Successive cheapest paths with potentials; a pattern's pass k costs k - 1 a word.
    """
    n_pat, source_at = len(capacity), {s: i for i, s in enumerate(quota)}
    pats = list(capacity)
    start, end = 0, 1 + n_pat + len(quota)
    graph: list[list[list]] = [[] for _ in range(end + 1)]

    def arc(u, v, room, cost):
        graph[u].append([v, room, cost, len(graph[v])])
        graph[v].append([u, 0, -cost, len(graph[u]) - 1])

    for i, p in enumerate(pats):
        for k in range(repeats):
            arc(start, 1 + i, capacity[p], k)
        for s in members[p]:
            arc(1 + i, 1 + n_pat + source_at[s], repeats * capacity[p], 0)
    for s, q in quota.items():
        arc(1 + n_pat + source_at[s], end, q, 0)
    height = [0] * (end + 1)
    while True:
        far, via, heap = [None] * (end + 1), [None] * (end + 1), [(0, start)]
        far[start] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for k, (v, room, cost, _) in enumerate(graph[u]):
                if room > 0 and (far[v] is None or d + cost + height[u] - height[v] < far[v]):
                    far[v] = d + cost + height[u] - height[v]
                    via[v] = (u, k)
                    heapq.heappush(heap, (far[v], v))
        if far[end] is None:
            break
        most = max(x for x in far if x is not None)
        height = [h + (f if f is not None else most) for h, f in zip(height, far)]
        path, v = [], end
        while v != start:
            u, k = via[v]
            path.append(graph[u][k])
            v = u
        push = min(a[1] for a in path)
        for a in path:
            a[1] -= push
            graph[a[0]][a[3]][1] += push
    flow, names = {}, list(quota)
    for i, p in enumerate(pats):
        for v, room, _, back in graph[1 + i]:
            if v > n_pat and v < end:
                s = names[v - 1 - n_pat]
                flow[p, s] = flow.get((p, s), 0) + repeats * capacity[p] - room
    return flow


def _digit(level: int) -> Column:
    """Digit of the order (the hash, then a hash of the row number), 12 bits a level."""
    key, level = ("__k1", level) if level < 5 else ("__k2", level - 5)
    return F.shiftrightunsigned(F.col(key), 64 - DIGIT * (level + 1)).bitwiseAND(F.lit((1 << DIGIT) - 1))


def _pack(digits: list[int]) -> int:
    return sum(d << DIGIT * (4 - i) for i, d in enumerate(digits))


def _from(t1: str, t2: str) -> Column:
    """Whether a row's two 60-bit keys are at or beyond a bound."""
    k1, k2 = F.shiftrightunsigned("__k1", 4), F.shiftrightunsigned("__k2", 4)
    return (k1 > F.col(t1)) | ((k1 == F.col(t1)) & (k2 >= F.col(t2)))


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A table of a row a pattern (numbers only, under 200 bytes each): broadcast if it is small."""
    return F.broadcast(table) if rows <= SMALL else table


def thresholds(rows: DataFrame, rest: dict[int, int], begin: dict[int, tuple[int, int]]) -> tuple[dict[int, tuple[int, int]], dict[int, int], set[int]]:
    """By pattern: the bounds below which a document's two 60-bit keys put it in the extra pass, and the words still missing; and the patterns with a document that did not fit.

    The documents of a pattern that are no larger than its rest, in key order from begin, fit into
    it up to one that does not; that one is found digit by digit. Only a histogram of 4096 buckets
    a pattern is sorted.
    """
    spark = rows.sparkSession
    prefix: dict[int, list[int]] = {p: [] for p in rest}
    left, live, stopped = dict(rest), set(rest), set()
    order = Window.partitionBy("pattern").orderBy("digit")
    for level in range(10):
        if not live:
            break
        names = ["pattern int", "most long", "rest long", "b1 long", "b2 long", *(f"d{i} long" for i in range(level))]
        table = [(p, left[p], rest[p], *begin[p], *prefix[p]) for p in sorted(live)]
        own = rows.join(_small(spark.createDataFrame(table, ", ".join(names)), len(table)), "pattern")
        own = own.where((F.col("size") > 0) & (F.col("size") <= F.col("rest")) & _from("b1", "b2"))
        for i in range(level):
            own = own.where(_digit(i) == F.col(f"d{i}"))
        counts = own.groupBy("pattern", "most", _digit(level).alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("n")).withColumn("upto", F.sum("words").over(order))
        over = F.when(F.col("upto") > F.col("most"), F.col("digit"))
        found = {r["pattern"]: r for r in counts.groupBy("pattern").agg(F.max("upto").alias("words"), F.min(over).alias("at"), F.min_by(F.struct("digit", "words", "n", "upto"), over).alias("b")).collect()}
        for p in sorted(live):
            b = found[p]["b"] if p in found and found[p]["at"] is not None else None
            prefix[p].append(1 << DIGIT if b is None else b["digit"])
            if b is None:
                left[p] -= found[p]["words"] if p in found else 0
            else:
                left[p] -= b["upto"] - b["words"]
                stopped.add(p)
            if b is None or b["n"] <= 1 or left[p] <= 0:
                live.discard(p)
    return {p: (_pack(d[:5]), _pack(d[5:])) for p, d in prefix.items()}, left, stopped


def fill(rows: DataFrame, rest: dict[int, int], full: dict[int, int], repeats: int) -> tuple[dict[int, list[tuple]], dict[int, int]]:
    """By pattern: rounds (most, begin, end) that each give one more pass to the documents of at most `most` words and keys from begin to below end; and the words still missing.

    A skipped document is larger than what is missing from then on. So within a pass the next round
    begins where the last one stopped, and in the next pass all that fit have been taken equally often.
    """
    rounds: dict[int, list[tuple]] = {p: [] for p in rest}
    left, done, begin = dict(rest), {p: full[p] for p in rest}, {p: (0, 0) for p in rest}
    while open_ := {p: n for p, n in left.items() if n > 0 and done[p] < repeats}:
        end, after, stopped = thresholds(rows, open_, begin)
        for p, most in open_.items():
            rounds[p].append((most, *begin[p], *end[p]))
            whole = p not in stopped or (after[p] == most and begin[p] == end[p])
            begin[p], left[p] = (0, 0) if whole else end[p], after[p]
            done[p] += whole
    return rounds, left


def _nearest(rows: DataFrame, left: dict[int, int], repeats: int) -> list[int]:
    """Row numbers: by pattern the document nearest in size to what is missing, if a pass of it is better than none."""
    open_ = [(p, n) for p, n in left.items() if n > 0]
    if not open_:
        return []
    want = rows.sparkSession.createDataFrame(open_, "pattern int, missing long")
    free = rows.join(_small(want, len(open_)), "pattern").where((F.col("full") + F.col("extra") < repeats) & (F.col("size") > 0))
    gap = F.abs(F.col("missing") - F.col("size"))
    best = free.where(gap < F.col("missing")).groupBy("pattern").agg(F.min(F.struct(gap.alias("gap"), "extra", "__k1", "__row")).alias("b")).collect()
    return [r["b"]["__row"] for r in best]


def mix(
    docs: DataFrame,
    sources: Column,
    weights: dict | None = None,
    seed: int = 0,
    repeats: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, size, sources, source_size, target, taken, passes of every row of docs, and the columns named in keep as a struct `kept`.

    sources: an array of source names (a null name is a source). source_size and target are sums
    over the row's sources. weights default to 1, 2, 3, 1, ... in code-point order, null last.
    """
    spark = docs.sparkSession
    whole = [F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []
    own = [word_count(F.col(text)).alias("__size"), F.array_sort(F.array_distinct(sources)).alias("__sources")]
    rows = docs.select(F.col(doc_id).alias("doc_id"), *whole, *own, F.monotonically_increasing_id().alias("__row"))
    keys = {"__k1": F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("__size")), "__k2": F.xxhash64(F.lit(seed), "__row")}
    rows = materialize(rows.withColumns(keys), "mix")
    patterns = rows.groupBy("__sources").agg(F.sum("__size").alias("words")).collect()
    patterns.sort(key=lambda r: [(s is None, s or "") for s in r[0] or []])
    pattern_of = {tuple(r[0]) if r[0] is not None else None: i for i, r in enumerate(patterns)}
    names = sorted({s for key in pattern_of for s in key or ()}, key=lambda s: (s is None, s or ""))
    weights = weights if weights is not None else {s: i % 3 + 1 for i, s in enumerate(names)}
    words = {i: r["words"] or 0 for i, r in enumerate(patterns)}
    members = {i: list(key or ()) for key, i in pattern_of.items()}
    sizes = dict.fromkeys(names, 0)
    for i, n in words.items():
        for s in members[i]:
            sizes[s] += n
    goal = quotas(sizes, weights, sum(words[i] for i in words if members[i]), repeats)  # a document counts once in the total
    capacity = {i: w for i, w in words.items() if w and members[i]}
    routed = dict.fromkeys(words, 0) | route(capacity, members, {s: round(q) for s, q in goal.items()}, repeats)
    full = {i: min(repeats, routed[i] // words[i]) if words[i] else 0 for i in words}
    rest = {i: routed[i] - full[i] * words[i] for i in words}
    table = [
        (list(key) if key is not None else None, i, full[i], sum(sizes[s] for s in members[i]), float(sum(goal[s] for s in members[i])))
        for key, i in pattern_of.items()
    ]
    kinds = (T.ArrayType(T.StringType()), T.IntegerType(), T.IntegerType(), T.LongType(), T.DoubleType())
    fields = zip(("__sources", "pattern", "full", "source_size", "target"), kinds)
    facts = spark.createDataFrame(table, T.StructType([T.StructField(n, k) for n, k in fields]))
    light = len(table) <= SMALL and sum(len(s or "") for key in pattern_of for s in key or ()) < 10_000_000
    facts = F.broadcast(facts) if light else facts
    known = rows.withColumnRenamed("__size", "size").join(facts, rows["__sources"].eqNullSafe(facts["__sources"])).drop(facts["__sources"])
    open_ = {p: r for p, r in rest.items() if r > 0}
    rounds, left = fill(known.select("pattern", "size", "__k1", "__k2"), open_, full, repeats)
    kind = "pattern int, __rounds array<struct<most:long,b1:long,b2:long,e1:long,e2:long>>"
    limits = spark.createDataFrame([(p, rounds.get(p, [])) for p in words], kind)
    k1, k2 = F.shiftrightunsigned("__k1", 4), F.shiftrightunsigned("__k2", 4)
    beyond = lambda r, t: (k1 > r[t + "1"]) | ((k1 == r[t + "1"]) & (k2 >= r[t + "2"]))
    taken = F.size(F.filter("__rounds", lambda r: (F.col("size") <= r["most"]) & beyond(r, "b") & ~beyond(r, "e")))
    marked = known.join(_small(limits, len(words)), "pattern")
    marked = marked.withColumn("extra", F.when(F.col("size") > 0, taken).otherwise(0)).drop("__rounds")
    picked = [(r, 1) for r in _nearest(marked, left, repeats)]
    picks = spark.createDataFrame(picked, "__row long, __pick int")
    out = marked.join(_small(picks, len(picked)), "__row", "left")  # at most a row a pattern
    passes = F.col("full") + F.col("extra") + F.coalesce("__pick", F.lit(0))
    out = out.withColumn("taken", (F.col("size") * passes).cast("bigint"))
    out = out.withColumn("passes", F.when(F.col("size") > 0, passes).otherwise(0))
    return out.select("doc_id", *["kept"] * bool(keep), "size", F.col("__sources").alias("sources"), "source_size", "target", "taken", "passes")
