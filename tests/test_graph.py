"""The golden ten-vertex graph, hand-made cases, and a random graph against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.algorithms import blocks, components, forest, ranks, strong
from weftgraph.algorithms.stars import star_components
from weftgraph import storage
from weftgraph.metrics import Timers
from weftgraph.model import Graph, from_edges
from weftgraph.operators import messages
from weftgraph.operators.messages import push, request, request_counts, spread
from weftgraph.operators.sort import global_rank, lag_in_order
from weftgraph.plans.supersteps import NotConverged
from weftgraph.sources import text

TOY = {1: [], 2: [3, 4], 3: [2, 4], 4: [2, 3, 5, 6], 5: [4, 6], 6: [4, 5], 7: [8, 9, 10], 8: [7, 9, 10], 9: [7, 8, 10], 10: [7, 8, 9]}
CC = {1: 1, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2, 7: 7, 8: 7, 9: 7, 10: 7}


@pytest.fixture(scope="module")
def toy(spark):
    rows = [(f"{v}\t{len(n)} {' '.join(map(str, n))}\r\r",) for v, n in TOY.items()] + [("",), ("  ",)]
    raw = spark.createDataFrame(rows, "value string").select(F.regexp_replace("value", r"\r+$", "").alias("value")).where(F.trim("value") != "")
    return text.parse_adjacency(raw)


def rows(df):
    return sorted(map(tuple, df.collect()))


def table(df):
    return {r[0]: r[1] for r in df.collect()}


def test_components_agree(toy):
    assert table(components.hash_min(toy)) == CC
    assert table(components.hash_min(toy, tau=3)) == CC
    assert table(components.pointer_jumping(toy)) == CC
    assert table(components.pointer_jumping(toy, star_hook=True, lookup=True)) == CC


def test_page_rank(toy):
    got = {k: round(v, 6) for k, v in table(ranks.page_rank(toy)).items()}
    assert got == {1: 0.016393, 2: 0.092994, 3: 0.092994, 4: 0.17447, 5: 0.092994, 6: 0.092994, 7: 0.10929, 8: 0.10929, 9: 0.10929, 10: 0.10929}


def test_paths(toy):
    got = {r[0]: (r[1], r[2]) for r in ranks.shortest_paths(toy, 2).collect()}
    assert got == {2: (0.0, -1), 3: (1.0, 2), 4: (1.0, 2), 5: (2.0, 4), 6: (2.0, 4)} | {v: (None, None) for v in (1, 7, 8, 9, 10)}
    assert "1\tunreachable" in {r[0] for r in text.distance_lines(ranks.shortest_paths(toy, 2)).collect()}


def test_preorder_and_blocks(toy):
    tree = blocks.spanning_forest(toy)
    order = {r["id"]: (r["parent"], r["pre"], r["nd"]) for r in blocks.preorder(tree).collect()}
    assert order == {2: (-1, 0, 5), 3: (2, 1, 1), 4: (2, 2, 3), 5: (4, 3, 1), 6: (4, 4, 1), 7: (-1, 0, 4), 8: (7, 1, 1), 9: (7, 2, 1), 10: (7, 3, 1), 1: (-1, 0, 1)}
    block = {}
    for u, v, a, b in blocks.biconnected(toy).collect():
        block.setdefault((a, b), set()).add((u, v))
    assert block == {(2, 3): {(2, 3), (2, 4), (3, 4)}, (4, 5): {(4, 5), (4, 6), (5, 6)}, (7, 8): {(7, 8), (7, 9), (7, 10), (8, 9), (8, 10), (9, 10)}}


def test_two_triangles(spark):
    """Self-loop, parallel edges and an edge to an id of its own, directed."""
    g = from_edges(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (6, 4), (7, 7), (6, 8)], "src long, dst long"))
    assert table(strong.strong_components(g)) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7, 8: 8}
    assert {k for k, v in table(strong.trim(g)).items() if v} == {7, 8}


def test_forest_against_kruskal(spark):
    rng = random.Random(3)
    edges = {(rng.randrange(40), rng.randrange(40)): rng.randrange(9) for _ in range(90)}
    g = from_edges(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src long, dst long, weight long"), undirected=True)
    best = {}
    for (a, b), w in edges.items():
        if a != b:
            key = (min(a, b), max(a, b))
            best[key] = min(w, best.get(key, w))
    root = list(range(40))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    want = []
    for w, hi, lo in sorted((w, b, a) for (a, b), w in best.items()):
        if find(lo) != find(hi):
            root[find(hi)] = find(lo)
            want.append((lo, hi, w))
    assert rows(forest.spanning_forest_edges(g)) == sorted(want)


def test_long_path_and_star(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)], "src long, dst long")
    got = table(star_components(path))
    assert {got[i] for i in range(61)} == {0} and {got[1000 + i] for i in range(50)} == {1000}
    assert star_components(path.where("src < 0")).count() == 0


def test_order_and_lookup(spark):
    df = spark.createDataFrame([(k % 5, k) for k in range(50)], "a long, b long")
    ranked = {(r["a"], r["b"]): r["rank"] for r in global_rank(df, ["a", "b"]).collect()}
    assert ranked == {k: i for i, k in enumerate(sorted(ranked))}
    lagged = sorted((r["a"], r["b"], r["p"]) for r in lag_in_order(df, ["a", "b"], "b", "p").collect())
    assert [x[2] for x in lagged] == [None, *[x[1] for x in lagged[:-1]]]
    asked = request(df.limit(3), df.select(F.col("b").alias("id")).where("id < 2"), "b", {"x": F.col("id")}, {"x": -1}, distinct=True)
    assert set(r["x"] for r in asked.collect()) <= {0, 1, -1}


def test_fastq_and_put(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"{k}.fq").write_text("".join(f"@r{i}\nSEQ{k}_{i}\n+\nII\n" for i in range(30)))
    target = f"file://{tmp_path}/out"
    assert text.put_fastq(spark, f"file://{tmp_path}/in", target)
    assert {r[0] for r in text.lines(spark, target).collect()} == {f"SEQ{k}_{i}" for k in range(2) for i in range(30)}
    assert not text.put(spark, f"file://{tmp_path}/in", target)
    assert text.put(spark, f"file://{tmp_path}/in", target, force=True)


def test_scc_layout(spark):
    lines = spark.createDataFrame([("-1\t4",), ("1\t-2 0 1 2 2 3 4",), ("3\t0 1 0 0",)], "value string")
    vertices, edges, color = text.parse_scc(lines)
    assert rows(vertices) == [(1, -2, 0), (3, 0, 1)] and rows(edges) == [(1, 3), (1, 4)] and color == 4
    written = text.scc_lines(vertices, edges.union(edges.select("dst", "src")), 7)
    back = text.parse_scc(written)
    assert rows(back[0]) == rows(vertices) and back[2] == 7 and rows(back[1]) == [(1, 3), (1, 4), (3, 1)]


def test_stage_layouts(spark):
    for layout in text.LAYOUTS.values():
        names = [*layout.keys, *layout.names]
        made = [tuple(range(k, k + len(names))) + (([k, k + 1] if k else []),) for k in range(3)]
        df = spark.createDataFrame(made, ", ".join([*(f"{n} long" for n in names), f"{layout.rest or 'unused'} array<long>"]))
        df = df if layout.rest else df.drop("unused")
        assert sorted(map(str, layout.parse(layout.lines(df)).collect())) == sorted(map(str, df.collect()))
    line = text.LAYOUTS["F6"].lines(spark.createDataFrame([(5, 2, -1)], "id long, color long, parent long")).first()[0]
    assert line == "5\t2 -1 #"


def test_files(spark, tmp_path):
    where = f"file://{tmp_path}"
    df = spark.createDataFrame([((k * 37) % 101, f"x{k}") for k in range(300)], "key long, content string")
    text.write_in_order(df, ["key", "content"], F.concat_ws(" ", "key", "content"), f"{where}/sorted", partitions=5)
    got = [r["value"] for r in text.read_in_order(spark, f"{where}/sorted").orderBy("rank").collect()]
    assert got == [f"{k} {c}" for k, c in sorted((r["key"], r["content"]) for r in df.collect())]
    text.write_lines(df.select(F.col("content").alias("value")).coalesce(1), f"{where}/parts", max_bytes=100)
    sizes = [f.stat().st_size for f in (tmp_path / "parts").glob("part-*")]
    assert max(sizes) <= 100 and len(sizes) > 10
    assert text.path_problems(spark, (f"{where}/none", " "), (f"{where}/parts",)) == ["input path is blank", f"input {where}/none does not exist", f"output {where}/parts exists already"]
    assert text.make_dir(spark, f"{where}/new") and not text.make_dir(spark, f"{where}/new") and text.check_dirs(spark, (f"{where}/new",))
    (tmp_path / "bin").write_bytes(b"0123456789")
    assert bytes(text.read_exactly(spark, f"{where}/bin", 3, 4).first()["data"]) == b"3456"
    with pytest.raises(Exception, match="too short"):
        text.read_exactly(spark, f"{where}/bin", 3, 8).collect()


def test_limits_raise(spark):
    """A loop that meets its limit gives an error, never a half-done result; a long path is right."""
    path = from_edges(spark.createDataFrame([(i, i + 1) for i in range(14)], "src long, dst long"), undirected=True)
    for job in (
        lambda: components.hash_min(path, max_steps=4),
        lambda: components.pointer_jumping(path, max_rounds=1),
        lambda: star_components(path.edges, max_rounds=1),
        lambda: strong.trim(from_edges(spark.createDataFrame([(i, i + 1) for i in range(14)], "src long, dst long")), max_rounds=2),
        lambda: blocks.list_ranks(blocks.euler_tour(blocks.spanning_forest(path)), max_rounds=2),
        lambda: blocks.spanning_forest(path, max_steps=3),
        lambda: forest.spanning_forest_edges(Graph(path.vertices, path.edges.withColumn("weight", F.lit(1))), max_rounds=0),
        lambda: forest.jump_to_roots(spark.createDataFrame([(i, max(0, i - 1)) for i in range(20)], "id long, parent long"), max_rounds=2),
    ):
        with pytest.raises(NotConverged):
            job()
    assert set(table(components.hash_min(path)).values()) == {0}  # 15 steps, most of them a few changed rows
    tree = {r["id"]: r["parent"] for r in blocks.colors_and_forest(path).collect()}
    assert tree == {0: -1} | {i: i - 1 for i in range(1, 15)}


def test_steps_count_messages(toy):
    run = components.min_label_run(toy, report=3)
    got = {s["step"]: s["received"] for s in run.steps}
    assert got[1] == 0 and got[2] == 9 and all(sum(s["workers"].values()) == s["received"] for s in run.steps)
    assert sum(r["n_messages"] for r in components.message_report(toy, 3).collect()) == sum(got.values())
    mirrored = components.min_label_run(toy, tau=3, report=1).steps
    assert mirrored[1]["mirrored"] == 5  # vertices 4 and 7 to 10


def test_hubs_keep_all_rows(spark, monkeypatch):
    """Hubs by broadcast and by salted keys give what a plain join gives."""
    edges = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(i, 0) for i in range(1, 200)] + [(7, 8)], "src long, dst long")
    states = spark.createDataFrame([(i, i * 2) for i in range(200)], "id long, x long")
    want = rows(states.join(edges, F.col("id") == F.col("src")).select("id", "x", "dst"))
    for most in (1 << 25, 1):
        monkeypatch.setattr(messages, "BROADCAST", most)
        own = spread(edges, tau=50)
        assert own.n_hubs == 1 and rows(own.along(states).select("id", "x", "dst")) == want
        assert own.mirrored(states) == 1
        own.release()


def test_lookups(spark):
    states = spark.createDataFrame([(1, 10), (2, 20)], "id long, x long")
    asks = spark.createDataFrame([(5, 1), (6, 1), (7, 9), (8, None)], "who long, at long")
    assert rows(request(asks, states, "at", {"x": F.col("x")}, distinct=True).select("who", "x").na.fill(-1)) == [(5, 10), (6, 10), (7, -1), (8, -1)]
    assert rows(request_counts(asks, states, "at")) == [(3, 2, 1, True)]
    told = push(spark.createDataFrame([(1, 5), (1, 5), (2, 6), (3, 6)], "by long, id long"), states, {"x": F.col("x")})
    assert rows(told) == [(5, 1, 10), (6, 2, 20)]


def test_blocks_and_strong_against_plain_python(spark):
    """Random graphs: blocks by removing each vertex, strong components by reachability, with many rounds and two."""
    rng = random.Random(5)
    pairs = {(rng.randrange(24), rng.randrange(24)) for _ in range(34)}

    def reach(near, start, without=None):
        seen, todo = {start}, [start]
        while todo:
            for y in near.get(todo.pop(), ()):
                if y not in seen and y != without:
                    seen.add(y)
                    todo.append(y)
        return seen

    out, both = {}, {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
        if a != b:
            both.setdefault(a, set()).add(b)
            both.setdefault(b, set()).add(a)
    df = spark.createDataFrame(sorted(pairs), "src long, dst long")
    ids = {x for p in pairs for x in p}
    to = {x: reach(out, x) for x in ids}
    want = {x: min(y for y in to[x] if x in to[y]) for x in ids}
    assert table(strong.strong_components(from_edges(df))) == want
    two = table(strong.strong_components(from_edges(df), rounds=2))
    assert all(c is None or c == want[x] for x, c in two.items())
    edges = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})
    block = {e: e for e in edges}

    def find(e):
        while block[e] != e:
            e = block[e]
        return e

    for x in ids:  # two edges at x share a block if their other ends meet without x
        for a in both.get(x, ()):
            for b in both.get(x, ()):
                if a < b and b in reach(both, a, without=x):
                    e, f = sorted((find((min(x, a), max(x, a))), find((min(x, b), max(x, b)))))
                    block[f] = e
    got = {(u, v): (a, b) for u, v, a, b in blocks.biconnected(from_edges(df, undirected=True)).collect()}
    assert got == {e: min(f for f in edges if find(f) == find(e)) for e in edges}


def test_storage_and_timers(spark):
    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Cluster)
    timers = Timers()
    with timers.span("a"):
        pass
    assert timers.seconds["a"] >= 0 and timers.report().startswith("a: ")
