"""What large graphs need: no table broadcast by its files, few shuffles, trees ranked in a task or between tasks alike."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.algorithms import blocks, components, whole
from weftgraph.model import from_edges, merged
from weftgraph.operators import messages
from weftgraph.sources import text
from weftgraph.storage import written


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def some_graph(spark, n=60, m=70, seed=7):
    """Undirected, with trees, cycles, self-loops, parallel edges and vertices without edges."""
    rng = random.Random(seed)
    pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
    pairs += pairs[:5] + [(3, 3), (n, n)]
    g = from_edges(spark.createDataFrame(pairs, "src long, dst long"), spark.range(n + 3), undirected=True)
    return g, pairs


def labels(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in range(n)}


def test_written_tables_are_not_taken_for_small(spark):
    """two million rows whose files take less than Spark broadcasts by; known numbers still are sent."""
    flat = written(spark.range(2_000_000).select("id", F.lit(7).alias("d")).where("id % 2 = 0"))
    joined = flat.join(flat.select("id", F.col("d").alias("e")), "id", "left")
    assert "BroadcastHashJoin" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert "BroadcastHashJoin" in plan(flat.join(messages.sized(written(spark.range(5)), 5), "id"))
    assert "BroadcastHashJoin" not in plan(flat.join(messages.sized(written(spark.range(5)), None), "id"))


def test_mirrors_only_where_they_pay(spark, monkeypatch):
    """a threshold that makes most vertices hubs copies no state 16 times."""
    edges = spark.createDataFrame([(i, j) for i in range(40) for j in range(5)], "src long, dst long")
    states = spark.range(40)
    monkeypatch.setattr(messages, "MIRRORS", 39)
    own = messages.spread(edges, tau=4)
    assert own.n_hubs == 0 and own.mirrored(states) == 0
    assert rows(own.along(states).select("id", "dst")) == rows(edges)
    assert (own.most, own.total, own.sources) == (5, 200, 40)
    own.release()
    monkeypatch.setattr(messages, "MIRRORS", 40)
    own = messages.spread(edges, tau=4)
    assert own.n_hubs == 40 and own.mirrored(states) == 40
    own.release()


@pytest.mark.parametrize("how", [{}, {"star_hook": True}, {"lookup": True}, {"star_hook": True, "lookup": True}])
def test_hooking_against_plain_python(spark, how):
    """every form, on a graph of several rounds, a forest of one, and no edges."""
    g, pairs = some_graph(spark)
    assert dict(rows(components.pointer_jumping(g, **how))) == labels(pairs, 63)
    none = from_edges(spark.createDataFrame([], "src long, dst long"), spark.range(3), undirected=True)
    assert rows(components.pointer_jumping(none, **how)) == [(0, 0), (1, 1), (2, 2)]


def test_forest_takes_one_round_of_hooks(spark, monkeypatch):
    """where hooks use up all links none is joined again."""
    made, real = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name="t": made.append(name) or real(df, name))
    links = spark.createDataFrame([(10 + i, i % 3) for i in range(20)] + [(100 + i, 10 + i % 20) for i in range(50)], "hi long, lo long")
    got = dict(rows(components.hooked(links)))
    assert got == {10 + i: i % 3 for i in range(20)} | {100 + i: i % 20 % 3 for i in range(50)}
    assert "links" not in made and made.count("hooks") == 1


def test_degrees_take_one_shuffle(spark):
    """vertices come up with the counts, also of parsed and merged graphs."""
    pairs = spark.createDataFrame([(1, 2), (1, 3), (None, 4)], "src long, dst long")
    g = from_edges(pairs, spark.range(3), undirected=True)
    assert rows(g.degrees()) == [(0, 0), (1, 2), (2, 1), (3, 1)] and sorted(r[0] for r in g.vertices.collect()) == [0, 1, 2, 3]
    assert plan(g.degrees()).count("Exchange hash") == 1
    lines = spark.createDataFrame([("5\t2 6 7",), ("8\t0",)], "value string")
    both = merged(g, text.parse_adjacency(lines))
    assert rows(both.degrees()) == [(0, 0), (1, 2), (2, 1), (3, 1), (5, 2), (6, 0), (7, 0), (8, 0)]
    assert plan(both.degrees()).count("Exchange hash") == 1


def test_forests_agree(spark, monkeypatch):
    """Labels and levels at once, components first, and two phases; all by definition."""
    g, pairs = some_graph(spark)
    want, near = labels(pairs, 63), {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    level = {x: 0 for x in want if want[x] == x}
    parent, todo = dict.fromkeys(level, -1), sorted(level)
    while todo:
        found = sorted({y for x in todo for y in near.get(x, ()) if y not in level})
        parent |= {y: min(x for x in todo if y in near.get(x, ())) for y in found}
        level |= {y: 1 for y in found}
        todo = found
    tree = sorted(((x, want[x], parent[x]) for x in want), key=str)
    assert rows(blocks.spanning_forest(g)) == tree
    assert rows(blocks.colors_and_forest(g)) == tree
    monkeypatch.setattr(blocks, "DENSE", 0)
    assert rows(blocks.spanning_forest(g)) == tree


def test_euler_tour_takes_one_shuffle(spark):
    """the window that finds the turns has all there is to say of an edge."""
    tree = spark.createDataFrame([(1, 1, -1), (2, 1, 1), (3, 1, 1), (4, 1, 2), (9, 9, -1)], "id long, color long, parent long")
    tour = blocks.euler_tour(tree)
    assert plan(tour).count("Exchange hash") == 1
    want = [(1, 2, 2, 4, 1, True), (2, 4, 4, 2, 1, True), (4, 2, 2, 1, 1, False), (2, 1, 1, 3, 1, False), (1, 3, 3, 1, 1, True), (3, 1, None, None, 1, False)]
    assert rows(tour.select("u", "v", "next_u", "next_v", "color", "forward")) == sorted(want, key=str)


def test_trees_in_a_task_and_between_tasks(spark, monkeypatch):
    """The same numbers where all trees fit, where some do, and where only single vertices do."""
    g, _ = some_graph(spark, 50, 80, 3)
    lone, _ = some_graph(spark, 12, 8, 5)
    shift = lambda df, *names: df.select(*[(F.col(c) + 1000).alias(c) for c in names])
    g = from_edges(g.edges.union(shift(lone.edges, "src", "dst")), g.vertices.union(shift(lone.vertices, "id")), undirected=True)
    tree, got = written(blocks.spanning_forest(g)), []
    for most in (1000, 5, 1):
        monkeypatch.setattr(whole, "FIT", most)
        order = written(blocks.preorder(tree))
        stats = blocks.subtree_minmax(order, written(blocks.merge_tree(g, order)))
        got.append((rows(order), rows(blocks.tour_positions(tree)), rows(stats)))
        monkeypatch.undo()
    assert got[0] == got[1] == got[2] and len(got[0][0]) > 50


def test_links_of_blocks_come_once(spark):
    """The auxiliary links need no distinct."""
    g, _ = some_graph(spark, 30, 60, 2)
    order = written(blocks.preorder(written(blocks.spanning_forest(g))))
    both = written(blocks.merge_tree(g, order))
    stats = written(blocks.subtree_minmax(order, both))
    links = rows(blocks.aux_graph(stats, both))
    assert links and len(set(links)) == len(links) and all(a < b for a, b in links)
    assert rows(blocks.aux_components(stats, blocks.aux_graph(stats, both))) == rows(blocks.aux_components(stats, blocks.aux_graph(stats, both), jumping=True))
