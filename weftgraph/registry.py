"""Queries of the graph library by name, on graphs derived from the relational tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import oracles
from weftgraph.algorithms import blocks, components, forest, ranks, strong
from weftgraph.model import Graph, from_edges, merged
from weftgraph.operators.messages import along_edges, combine, request, request_counts
from weftgraph.operators.sort import tera_sort
from weftgraph.plans.supersteps import Program, run
from weftgraph.sources import tables, text
from weftgraph.storage import scratch_path, written

Query = Callable[[SparkSession, str], DataFrame]
#: From this degree on, vertices are mirrored.
TAU = 4


def _written(graph: Graph) -> Graph:
    """The derived graph, computed once: loops read it many times."""
    return Graph(written(graph.vertices, "vertices"), written(graph.edges, "edges"))


def sales(spark: SparkSession, sf_dir: str, once: bool = False) -> Graph:
    """once: the vertices are read once, so they are not written."""
    edges, customers = tables.sales_edges(spark, sf_dir)
    g = from_edges(written(edges, "edges"), customers, undirected=True)
    return g if once else Graph(written(g.vertices, "vertices"), g.edges)


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    g = from_edges(written(tables.supply_edges(spark, sf_dir), "edges"), undirected=True)
    return Graph(written(g.vertices, "vertices"), g.edges)


def events(spark: SparkSession, sf_dir: str) -> Graph:
    return _written(tables.event_graph(spark, sf_dir))


def visits(spark: SparkSession, sf_dir: str) -> Graph:
    return _written(tables.visit_graph(spark, sf_dir))


def _first(graph: Graph) -> int:
    return graph.vertices.agg(F.min("id")).first()[0] or 0


def _rounded(ranked: DataFrame) -> DataFrame:
    return ranked.select("id", F.round("rank", 6).alias("rank"))


def graph_vertices(spark, sf_dir):
    return tables.sales_graph(spark, sf_dir).vertices.select("id")


def graph_degrees(spark, sf_dir):
    return tables.sales_graph(spark, sf_dir).degrees()


def adjacency_text_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "text")
    text.write_lines(text.adjacency_lines(tables.supply_graph(spark, sf_dir), weighted=True), path, max_bytes=text.PART)
    return text.parse_adjacency(text.lines(spark, path), weighted=True).edges


def multi_input(spark, sf_dir):
    """Degrees over two inputs of different layouts: sales without weights, supply with them."""
    paths = [scratch_path(spark, "input") for _ in range(2)]
    text.write_lines(text.adjacency_lines(tables.sales_graph(spark, sf_dir)), paths[0])
    text.write_lines(text.adjacency_lines(tables.supply_graph(spark, sf_dir), weighted=True), paths[1])
    plain, weighted = (text.lines(spark, p) for p in paths)
    return merged(text.parse_adjacency(plain), text.parse_adjacency(weighted, weighted=True)).degrees()


def cc_sizes(spark, sf_dir):
    return components.component_sizes(components.pointer_jumping(sales(spark, sf_dir, once=True)))


def sssp(spark, sf_dir, **how):
    g = supply(spark, sf_dir)
    return ranks.shortest_paths(g, _first(g), **how)


def fieldbcast(spark, sf_dir, **how):
    g = tables.event_graph(spark, sf_dir)
    return ranks.field_broadcast(g, g.vertices.select("id", (F.col("id") * 7).alias("field")), **how)


def fieldbcast_lookup(spark, sf_dir):
    """Over the sales graph; of its vertices only customers have a field."""
    g = tables.sales_graph(spark, sf_dir)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    fields = customers.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("bigint").alias("field"))
    return ranks.field_broadcast(g, fields, lookup=True, default=-1)


def fieldbcast_pushed(spark, sf_dir):
    g = tables.visit_graph(spark, sf_dir)
    return ranks.field_pushed(g, g.vertices.select("id", (F.col("id") * 7).alias("field")), default=0)


def msf(spark, sf_dir, **how):
    return forest.spanning_forest_edges(supply(spark, sf_dir), **how)


def msf_weight(spark, sf_dir):
    return msf(spark, sf_dir).agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"))


def scc_decompose(spark, sf_dir):
    g = visits(spark, sf_dir)
    return strong.decompose(g, written(strong.min_labels(g), "labels"))[0]


def scc_sizes(spark, sf_dir):
    return components.component_sizes(strong.strong_components(visits(spark, sf_dir)))


def _tree(spark, sf_dir):
    return written(blocks.spanning_forest(sales(spark, sf_dir, once=True)), "tree")


def _ordered(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    g = supply(spark, sf_dir)
    order = written(blocks.preorder(written(blocks.spanning_forest(g), "tree")), "order")
    return order, written(blocks.merge_tree(g, order), "merged")


def _stats(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    order, edges = _ordered(spark, sf_dir)
    return written(blocks.subtree_minmax(order, edges), "stats"), edges


def aux_cc(spark, sf_dir, **how):
    stats, edges = _stats(spark, sf_dir)
    return blocks.aux_components(stats, blocks.aux_graph(stats, edges), **how)


def case1_mark(spark, sf_dir):
    stats, edges = _stats(spark, sf_dir)
    return blocks.mark_non_tree(edges, blocks.aux_components(stats, blocks.aux_graph(stats, edges)))


def _items(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(F.col("user_id").alias("key"), F.col("event_id").cast("string").alias("content"))


def terasort_dump(spark, sf_dir):
    """Items written in order by range partitions, and read back with the places that files and lines give them."""
    path = scratch_path(spark, "sorted")
    line = F.concat_ws(chr(9), F.col("key").cast("string"), "content")
    text.write_in_order(_items(spark, sf_dir), ["key", "content"], line, path)
    cells = F.split("value", chr(9))
    return text.read_in_order(spark, path).select("rank", cells[0].cast("bigint").alias("key"), cells[1].alias("content"))


def aggregators(spark, sf_dir):
    """AND, sum and maximum over computed vertices, as the program's control would see them."""
    g = supply(spark, sf_dir)
    seen = {}
    on = lambda x: F.when(F.col("__on"), x)
    program = Program(
        initial={"degree": F.col("degree")},
        compute=lambda c: seen.update(c.aggregates) or {},
        stay_active=lambda c: F.lit(c.step < 2),
        aggregates={
            "all_linked": F.bool_and(on(F.col("degree") > 0)),
            "total": F.sum(on(F.col("degree"))),
            "most": F.max(on(F.col("degree"))),
        },
    )
    run(Graph(g.degrees(), g.edges), program)
    row = [(seen["all_linked"], seen["total"], seen["most"])]
    return spark.createDataFrame(row, "all_linked boolean, total bigint, most bigint")


def aggregator_count_map(spark, sf_dir):
    """Vertices by degree, counted by a map aggregator in one step and joined to by each vertex in the next."""
    g = supply(spark, sf_dir)
    seen = {}
    program = Program(
        initial={"degree": F.col("degree")},
        compute=lambda c: seen.update(c.groups) or {},
        stay_active=lambda c: F.lit(c.step < 2),
        groups={"alike": F.col("degree")},
    )
    state = run(Graph(written(g.degrees(), "degrees"), g.edges), program).state
    return state.join(seen["alike"].withColumnRenamed("key", "degree"), "degree").select("id", "degree", F.col("n").alias("alike"))


def combiners(spark, sf_dir):
    """Messages along edges, combined by minimum, sum and argmin."""
    g = tables.event_graph(spark, sf_dir)
    sent = along_edges(g.degrees(), g.edges, tau=TAU)
    return combine(sent, least=F.min("id"), total=F.sum("id"), slowest=F.min(F.struct("degree", "id"))["id"])


def request_respond(spark, sf_dir):
    """Each edge asks its target for the square of its degree."""
    g = tables.event_graph(spark, sf_dir)
    squared = {"answer": F.col("degree") * F.col("degree")}
    return request(g.edges.select("src", "dst"), g.degrees(), "dst", squared, distinct=True)


def _asks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Every event asks for a supplier of its user's number; some of these do not exist."""
    asks = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").alias("target"))
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return asks, suppliers.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("bigint").alias("nation"))


def request_missing(spark, sf_dir):
    """Answers of suppliers to events; null where there is none."""
    asks, states = _asks(spark, sf_dir)
    return request(asks, states, "target", {"nation": F.col("nation")}, distinct=True)


def request_counters(spark, sf_dir):
    return request_counts(*_asks(spark, sf_dir), "target")


def missing_targets(spark, sf_dir):
    """Each vertex sends 1 to itself and 1 to an id that does not exist; what is lost stops nobody."""
    both = F.explode(F.array(F.col("id"), -F.col("id") - 1))
    program = Program(
        initial={"got": F.lit(0).cast("bigint")},
        compute=lambda c: {} if c.step == 1 else {"got": F.col("got") + F.coalesce("msg_n", F.lit(0))},
        combine={"n": F.sum("n")},
        send=lambda c: F.lit(c.step == 1),
        messages=lambda c, state, g: state.where("sends").select(both.alias("dst"), F.lit(1).alias("n")),
    )
    return run(supply(spark, sf_dir), program).state


def vertex_add(spark, sf_dir):
    """Each vertex sends to a vertex that it adds in the same step; each new one counts what reaches it."""
    target = (F.col("id") % 10) + 9_000_000_000_000
    fresh = lambda state: state.select(target.alias("id"), F.lit(0).cast("bigint").alias("got"))
    program = Program(
        initial={"got": F.lit(0).cast("bigint")},
        compute=lambda c: {} if c.step == 1 else {"got": F.col("got") + F.coalesce("msg_n", F.lit(0))},
        combine={"n": F.sum("n")},
        send=lambda c: F.lit(c.step == 1),
        add=lambda c, state: fresh(state) if c.step == 1 else None,
        messages=lambda c, state, g: state.where("sends").select(target.alias("dst"), F.lit(1).alias("n")),
    )
    return run(supply(spark, sf_dir), program).state


def force_terminate(spark, sf_dir):
    """Labels after two steps: the messages of the second step are lost."""
    program = Program(
        initial={"label": F.col("id")},
        compute=lambda c: {"label": F.least("label", "msg_label")} if c.step > 1 else {},
        message={"label": F.col("label")},
        combine={"label": F.min("label")},
        send=lambda c: F.lit(True) if c.step == 1 else F.col("label") != F.col("old_label"),
        control=lambda c: "terminate" if c.step == 3 else None,
    )
    return run(sales(spark, sf_dir), program).state


def wake_all(spark, sf_dir):
    """All vertices are woken for steps 2 and 3, and then stop."""
    program = Program(
        initial={"computed": F.lit(0).cast("bigint")},
        compute=lambda c: {"computed": F.col("computed") + 1},
        control=lambda c: "wake" if c.step <= 3 else None,
    )
    return run(supply(spark, sf_dir), program).state


def layouts_roundtrip(spark, sf_dir):
    """(layout, n, same): rows of each stage's text layout, and whether they were the same when read back."""
    stats, edges = _stats(spark, sf_dir)
    labels = written(blocks.aux_components(stats, blocks.aux_graph(stats, edges)), "labels")
    near = written(edges.groupBy("color", "pre", "nd").agg(F.sort_array(F.collect_list("nbr_pre")).alias("nbrs")), "near")
    tour = blocks.euler_tour(stats)
    ranked = blocks.tour_positions(stats.select("id", "color", "parent")).withColumn("prev_u", F.col("u")).withColumn("prev_v", F.col("v"))
    aux = stats.join(labels, "id").select("color", F.col("parent").alias("p"), F.col("id").alias("u"), "label")
    aux = aux.withColumns({"c1": F.col("label"), "c2": F.col("label"), "links": F.array("label", "u")})
    found = blocks.block_ids(blocks.mark_non_tree(edges, labels)).select("u", "v", F.lit(0).alias("color"), F.col("bcc_u").alias("c1"), F.col("bcc_v").alias("c2"))
    rows = {
        "F5": stats.join(near, ["color", "pre", "nd"]).select("id", "color", "nbrs"),
        "F6": stats,
        "F7": tour.where("next_u is not null"),
        "F8": ranked.withColumn("dist", F.col("position")),
        "F9": stats,
        "F10": near,
        "F11": stats.join(near, ["color", "pre", "nd"]),
        "F12": aux,
        "F13": aux,
        "F14": aux,
        "F15": found,
    }
    out = None
    for name, layout in text.LAYOUTS.items():
        columns = [*layout.keys, *layout.names, *([layout.rest] if layout.rest else [])]
        kept = [c if c == layout.rest else F.col(c).cast("bigint").alias(c) for c in columns]
        own, path = written(rows[name].select(*kept), name), scratch_path(spark, name)
        text.write_lines(layout.lines(own), path)
        back = layout.parse(text.lines(spark, path))
        digest = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h"))  # noqa: B023, E731
        a, b = digest(own), digest(back).withColumnsRenamed({"n": "n2", "h": "h2"})
        one = a.join(b, F.col("n") == F.col("n2")).select(F.lit(name).alias("layout"), "n", (F.col("h") == F.col("h2")).alias("same"))
        out = one if out is None else out.union(one)
    return out


def put_fastq(spark, sf_dir):
    source, target = scratch_path(spark, "fastq"), scratch_path(spark, "reads")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"))
    record = F.array(F.format_string("@%d", "k"), F.format_string("ACGT%d", "k"), F.lit("+"), F.lit("IIII"))
    # explode keeps a record's lines together in a part
    text.write_lines(rows.select(F.explode(record).alias("value")), source)
    text.put_fastq(spark, source, target)
    return text.lines(spark, target)


def put_dir(spark, sf_dir):
    source, target = scratch_path(spark, "local"), scratch_path(spark, "put")
    text.write_lines(text.adjacency_lines(tables.event_graph(spark, sf_dir)), source, max_bytes=100_000)
    text.put(spark, source, target)
    return text.parse_adjacency(text.lines(spark, target)).degrees()


def queries() -> dict[str, Query]:
    named: dict[str, Query] = {
        "graph_vertices": graph_vertices,
        "graph_degrees": graph_degrees,
        "adjacency_text_roundtrip": adjacency_text_roundtrip,
        "multi_input": multi_input,
        "hashmin_cc": lambda s, d: components.hash_min(sales(s, d)),
        "hashmin_cc_mirror": lambda s, d: components.hash_min(sales(s, d), tau=TAU),
        "cc_adjacency": lambda s, d: components.keeping_adjacency(sales(s, d)),
        "sv_cc": lambda s, d: components.pointer_jumping(sales(s, d, once=True), star_hook=True),
        "svplus_cc": lambda s, d: components.pointer_jumping(sales(s, d, once=True)),
        "sv_cc_lookup": lambda s, d: components.pointer_jumping(sales(s, d, once=True), star_hook=True, lookup=True),
        "sv_cc_cyclic": lambda s, d: components.pointer_jumping(supply(s, d), star_hook=True),
        "cc_sizes": cc_sizes,
        "cc_message_report": lambda s, d: components.message_report(sales(s, d)),
        "pagerank": lambda s, d: _rounded(ranks.page_rank(events(s, d))),
        "pagerank_mirror": lambda s, d: _rounded(ranks.page_rank(events(s, d), tau=TAU)),
        "sssp": sssp,
        "sssp_mirror": lambda s, d: sssp(s, d, tau=TAU),
        "sssp_weighted": lambda s, d: sssp(s, d, weighted=True),
        "sssp_weighted_mirror": lambda s, d: sssp(s, d, weighted=True, tau=TAU),
        "fieldbcast_directed": lambda s, d: fieldbcast(s, d, directed=True),
        "fieldbcast_undirected": lambda s, d: fieldbcast(s, d, directed=False),
        "fieldbcast_lookup": fieldbcast_lookup,
        "fieldbcast_pushed": fieldbcast_pushed,
        "msf": msf,
        "msf_lookup": lambda s, d: msf(s, d, lookup=True),
        "msf_weight": msf_weight,
        "scc_trim": lambda s, d: strong.trim(visits(s, d)),
        "scc_minlabel": lambda s, d: strong.min_labels(visits(s, d)),
        "scc_decompose": scc_decompose,
        "scc": lambda s, d: strong.strong_components(visits(s, d)),
        "scc_two_rounds": lambda s, d: strong.strong_components(visits(s, d), rounds=2),
        "scc_sizes": scc_sizes,
        "scc_dense": lambda s, d: strong.strong_components(events(s, d)),
        "spanning_forest": _tree,
        "multi_phase": lambda s, d: blocks.colors_and_forest(sales(s, d, once=True)),
        "euler_tour": lambda s, d: blocks.euler_tour(_tree(s, d)),
        "list_rank": lambda s, d: blocks.tour_positions(_tree(s, d)),
        "preorder": lambda s, d: blocks.preorder(_tree(s, d)).select("id", "color", "pre"),
        "subtree_size": lambda s, d: blocks.preorder(_tree(s, d)).select("id", "color", "nd"),
        "merge_tree_edges": lambda s, d: _ordered(s, d)[1],
        "subtree_minmax": lambda s, d: _stats(s, d)[0],
        "aux_graph": lambda s, d: blocks.aux_graph(*_stats(s, d)),
        "aux_cc": aux_cc,
        "aux_sv": lambda s, d: aux_cc(s, d, jumping=True),
        "case1_mark": case1_mark,
        "bcc": lambda s, d: blocks.biconnected(supply(s, d)),
        "terasort": lambda s, d: tera_sort(_items(s, d)),
        "terasort_prefix": lambda s, d: tera_sort(_items(s, d), prefix=True),
        "terasort_dump": terasort_dump,
        "aggregators": aggregators,
        "aggregator_count_map": aggregator_count_map,
        "combiners": combiners,
        "request_respond": request_respond,
        "request_missing": request_missing,
        "request_counters": request_counters,
        "missing_targets": missing_targets,
        "vertex_add": vertex_add,
        "force_terminate": force_terminate,
        "wake_all": wake_all,
        "layouts_roundtrip": layouts_roundtrip,
        "put_fastq": put_fastq,
        "put_dir": put_dir,
    }
    return named


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
