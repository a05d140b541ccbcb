"""The queries' rows as DuckDB SQL, by definitions as far from the plans as SQL allows."""

from __future__ import annotations

_BOTH = "e AS MATERIALIZED (SELECT u AS src, v AS dst{w} FROM o UNION ALL SELECT v, u{w} FROM o)"
_LAG = "(SELECT lag(user_id) OVER (ORDER BY ts, event_id) AS p, user_id, ts, event_id FROM events)"

SALES = f"""o AS MATERIALIZED (SELECT o_custkey AS u, 10000000000 + o_orderkey AS v FROM orders
  UNION SELECT 10000000000 + l_orderkey, 1000000000000 + l_orderkey * 8 + l_linenumber FROM lineitem),
{_BOTH.format(w="")}, vs AS MATERIALIZED (SELECT c_custkey AS id FROM customer UNION SELECT src FROM e)"""
SUPPLY = f"""o AS MATERIALIZED (SELECT l_partkey AS u, 1000000000 + l_suppkey AS v,
  min(CAST(l_quantity * 100 + l_linenumber AS bigint)) AS weight FROM lineitem GROUP BY ALL),
{_BOTH.format(w=", weight")}, vs AS MATERIALIZED (SELECT DISTINCT src AS id FROM e)"""
EVENTS = f"""e AS MATERIALIZED (SELECT DISTINCT p AS src, user_id AS dst FROM {_LAG} WHERE p IS NOT NULL AND p <> user_id),
vs AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"""
VISITS = f"""e AS MATERIALIZED (SELECT DISTINCT src, unnest([a, z]) AS dst FROM (SELECT p AS src,
  arg_min(user_id, (ts, event_id)) AS a, arg_max(user_id, (ts, event_id)) AS z FROM {_LAG} WHERE p IS NOT NULL GROUP BY p)),
vs AS MATERIALIZED (SELECT DISTINCT user_id AS id FROM events WHERE user_id IS NOT NULL)"""
CC = "cc(id, lab) USING KEY (id) AS (SELECT id, id FROM vs UNION SELECT e.dst, min(cc.lab) FROM cc JOIN e ON e.src = cc.id JOIN recurring.cc AS r ON r.id = e.dst WHERE cc.lab < r.lab GROUP BY e.dst)"
TREE = f"""{CC},
b(id, d, par, color) USING KEY (id) AS (SELECT DISTINCT lab, 0, CAST(-1 AS bigint), lab FROM cc UNION SELECT e.dst, b.d + 1, min(b.id), b.color FROM b JOIN e ON e.src = b.id WHERE e.dst NOT IN (SELECT id FROM recurring.b) GROUP BY e.dst, b.d, b.color),
t(id, color, par, d, path) AS (SELECT id, color, par, d, [id] FROM b WHERE par = -1 UNION ALL SELECT b.id, b.color, b.par, b.d, list_append(t.path, b.id) FROM t JOIN b ON b.par = t.id)"""
ORDER = f"""{TREE},
sizes AS (SELECT a AS id, count(*) AS nd FROM (SELECT unnest(path) AS a FROM t) GROUP BY a),
ord AS MATERIALIZED (SELECT t.id, t.color, t.par AS parent, t.d, row_number() OVER (PARTITION BY color ORDER BY path) - 1 AS pre, nd FROM t JOIN sizes USING (id))"""
MERGED = f"{ORDER}, mt AS MATERIALIZED (SELECT a.id AS u, b.id AS v, a.color, a.pre, a.nd, b.pre AS nbr_pre, (a.parent = b.id OR b.parent = a.id) AS is_tree FROM e JOIN ord a ON a.id = e.src JOIN ord b ON b.id = e.dst)"
STATS = f"""{MERGED},
loc AS (SELECT ord.color, ord.pre, least(ord.pre, min(mt.nbr_pre)) AS a, greatest(ord.pre, max(mt.nbr_pre)) AS z FROM ord LEFT JOIN mt ON mt.u = ord.id AND NOT mt.is_tree GROUP BY ord.color, ord.pre),
st AS MATERIALIZED (SELECT o.id, o.color, o.parent, o.pre, o.nd, min(l.a) AS mn, max(l.z) AS mx FROM ord o JOIN loc l ON l.color = o.color AND l.pre BETWEEN o.pre AND o.pre + o.nd - 1 GROUP BY ALL)"""
AUX = f"""{STATS},
ax AS MATERIALIZED (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM (SELECT u AS x, v AS y FROM mt WHERE NOT is_tree AND pre < nbr_pre AND nbr_pre >= pre + nd UNION ALL SELECT c.id, p.id FROM st c JOIN st p ON p.id = c.parent WHERE p.parent >= 0 AND (c.mn < p.pre OR c.mx >= p.pre + p.nd)))"""
LABELS = f"""{AUX}, xe AS MATERIALIZED (SELECT a AS src, b AS dst FROM ax UNION ALL SELECT b, a FROM ax),
al(id, lab) USING KEY (id) AS (SELECT id, id FROM st WHERE parent >= 0 UNION SELECT xe.dst, min(al.lab) FROM al JOIN xe ON xe.src = al.id JOIN recurring.al AS r ON r.id = xe.dst WHERE al.lab < r.lab GROUP BY xe.dst)"""
REACH = f"{VISITS}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b), rr AS MATERIALIZED (SELECT a, b FROM r UNION SELECT id, id FROM vs)"
MINLABEL = f"{REACH}, mf AS MATERIALIZED (SELECT b AS id, min(a) AS min_forward FROM rr GROUP BY b), ml AS MATERIALIZED (SELECT mf.id, mf.min_forward, coalesce(min(roots.id), -1) AS min_backward FROM mf LEFT JOIN (SELECT rr.a, m.id FROM rr JOIN mf m ON m.id = rr.b AND m.min_forward = m.id) roots ON roots.a = mf.id GROUP BY ALL)"
SCC = f"{REACH}, sc AS MATERIALIZED (SELECT x.b AS id, min(x.a) AS component FROM rr x JOIN rr y ON x.a = y.b AND x.b = y.a GROUP BY x.b)"


def _scc_round(k: int) -> str:
    """Trims v{k} with edges e{k} (without self-loops), labels what is left, and cuts it into v{k+1}, e{k+1}; open groups in g{k}."""
    return f"""r{k}(a, b) AS (SELECT src, dst FROM e{k} UNION SELECT r{k}.a, x.dst FROM r{k} JOIN e{k} x ON x.src = r{k}.b),
cy{k} AS MATERIALIZED (SELECT a AS id FROM r{k} WHERE a = b),
co{k} AS MATERIALIZED (SELECT id FROM v{k} WHERE id IN (SELECT id FROM cy{k} UNION SELECT b FROM r{k} WHERE a IN (SELECT id FROM cy{k}))
  AND id IN (SELECT id FROM cy{k} UNION SELECT a FROM r{k} WHERE b IN (SELECT id FROM cy{k}))),
rr{k} AS MATERIALIZED (SELECT a, b FROM r{k} WHERE a IN (SELECT id FROM co{k}) AND b IN (SELECT id FROM co{k}) UNION SELECT id, id FROM co{k}),
mf{k} AS MATERIALIZED (SELECT b AS id, min(a) AS f FROM rr{k} GROUP BY b),
ml{k} AS MATERIALIZED (SELECT m.id, m.f, coalesce(min(t.id), -1) AS w FROM mf{k} m LEFT JOIN
  (SELECT x.a, y.id FROM rr{k} x JOIN mf{k} y ON y.id = x.b AND y.f = y.id) t ON t.a = m.id GROUP BY ALL),
g{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY f, w) AS n FROM ml{k}),
d{k} AS MATERIALIZED (SELECT id, id AS component FROM v{k} WHERE id NOT IN (SELECT id FROM co{k})
  UNION ALL SELECT id, CASE WHEN f = w THEN f END FROM g{k} WHERE f = w OR n <= 3),
v{k + 1} AS MATERIALIZED (SELECT id FROM g{k} WHERE f <> w AND n > 3),
e{k + 1} AS MATERIALIZED (SELECT x.src, x.dst FROM e{k} x JOIN g{k} a ON a.id = x.src JOIN g{k} b ON b.id = x.dst
  WHERE a.f = b.f AND a.w = b.w AND a.f <> a.w AND a.n > 3)"""


def _message_steps(most: int = 8) -> str:
    """Messages delivered in each step of min-label propagation, step by step."""
    out = [f"WITH {SALES}, l1 AS (SELECT id, id AS lab, true AS sends FROM vs)"]
    for k in range(2, most + 1):
        out.append(f"m{k} AS MATERIALIZED (SELECT e.dst AS id, min(l.lab) AS lab FROM l{k - 1} l JOIN e ON e.src = l.id WHERE l.sends GROUP BY e.dst), l{k} AS MATERIALIZED (SELECT l.id, least(l.lab, m.lab) AS lab, coalesce(m.lab < l.lab, false) AS sends FROM l{k - 1} l LEFT JOIN m{k} m USING (id))")
    rows = " UNION ALL ".join(f"SELECT {k} AS step, count(*) AS n_messages FROM m{k}" for k in range(2, most + 1))
    return ", ".join(out) + f" SELECT CAST(step AS bigint) AS step, n_messages FROM (SELECT 1 AS step, 0 AS n_messages UNION ALL {rows}) WHERE step = 1 OR n_messages > 0"


TOUR = """tt AS (SELECT par AS u, id AS v, color, true AS forward FROM b WHERE par >= 0 UNION ALL SELECT id, par, color, false FROM b WHERE par >= 0),
turn AS (SELECT u AS v, v AS u, lead(v) OVER w AS nxt, first(v) OVER w AS head FROM tt WINDOW w AS (PARTITION BY u ORDER BY forward, v))"""
def _pagerank(updates: int = 10) -> str:
    out = [f"WITH {EVENTS}, n AS (SELECT count(*)::double AS n FROM vs), dg AS MATERIALIZED (SELECT id, count(e.dst) AS degree FROM vs LEFT JOIN e ON e.src = vs.id GROUP BY id), p0 AS (SELECT id, degree, 1 / n AS rank FROM dg, n)"]
    for k in range(updates):
        out.append(f"s{k} AS (SELECT coalesce(sum(rank), 0) AS s FROM p{k} WHERE degree = 0), i{k} AS (SELECT e.dst AS id, sum(rank / degree) AS got FROM p{k} JOIN e ON e.src = p{k}.id GROUP BY e.dst), p{k + 1} AS MATERIALIZED (SELECT dg.id, dg.degree, 0.15 / n + 0.85 * (coalesce(got, 0) + s / n) AS rank FROM dg LEFT JOIN i{k} USING (id), s{k}, n)")
    return ", ".join(out) + f" SELECT id, round(rank, 6) AS rank FROM p{updates}"


def oracle_sql() -> dict[str, str]:
    cc = f"WITH RECURSIVE {SALES}, {CC} SELECT id, lab AS component FROM cc"
    pagerank = _pagerank()
    sssp = f"""WITH RECURSIVE {SUPPLY}, b(id, d) USING KEY (id) AS (SELECT min(id), 0 FROM vs UNION SELECT e.dst, min(b.d) + 1 FROM b JOIN e ON e.src = b.id WHERE e.dst NOT IN (SELECT id FROM recurring.b) GROUP BY e.dst),
pv AS (SELECT e.dst AS id, min(q.id) AS prev FROM e JOIN b q ON q.id = e.src JOIN b t ON t.id = e.dst AND q.d = t.d - 1 GROUP BY e.dst)
SELECT vs.id, CAST(b.d AS double) AS dist, CASE WHEN b.d = 0 THEN -1 ELSE pv.prev END AS prev FROM vs LEFT JOIN b ON b.id = vs.id LEFT JOIN pv ON pv.id = vs.id"""
    weighted = f"""WITH RECURSIVE {SUPPLY}, b(id, d) USING KEY (id) AS (SELECT min(id), CAST(0 AS bigint) FROM vs UNION SELECT e.dst, min(b.d + e.weight) FROM b JOIN e ON e.src = b.id LEFT JOIN recurring.b AS r ON r.id = e.dst WHERE r.d IS NULL OR b.d + e.weight < r.d GROUP BY e.dst),
pv AS (SELECT e.dst AS id, min(q.id) AS prev FROM e JOIN b q ON q.id = e.src JOIN b t ON t.id = e.dst AND q.d + e.weight = t.d GROUP BY e.dst)
SELECT vs.id, CAST(b.d AS double) AS dist, CASE WHEN b.d = 0 THEN -1 ELSE pv.prev END AS prev FROM vs LEFT JOIN b ON b.id = vs.id LEFT JOIN pv ON pv.id = vs.id"""
    tree = f"WITH RECURSIVE {SALES}, {TREE}"
    order = f"WITH RECURSIVE {SALES}, {ORDER}"
    merged, stats, aux, labels = (f"WITH RECURSIVE {SUPPLY}, {x}" for x in (MERGED, STATS, AUX, LABELS))
    marked = "SELECT least(mt.u, mt.v) AS u, greatest(mt.u, mt.v) AS v, al.lab AS label FROM mt JOIN al ON al.id = mt.v WHERE mt.pre < mt.nbr_pre"
    items = "SELECT user_id AS key, CAST(event_id AS varchar) AS content FROM events"
    ranked = f"SELECT key, content, row_number() OVER (ORDER BY key, content) - 1 AS rank FROM ({items})"
    aux_labels = f"{labels} SELECT id, lab AS label FROM al"
    scc_rounds = f"WITH RECURSIVE {VISITS}, v1 AS (SELECT id FROM vs), e1 AS MATERIALIZED (SELECT src, dst FROM e WHERE src <> dst), {_scc_round(1)}, {_scc_round(2)} SELECT id, component FROM d1 UNION ALL SELECT id, component FROM d2 UNION ALL SELECT id, NULL FROM v3"
    asks = "(SELECT event_id, user_id AS target FROM events) a LEFT JOIN (SELECT s_suppkey AS id, CAST(s_nationkey AS bigint) AS nation FROM supplier) s ON s.id = a.target"
    return {
        "graph_vertices": f"WITH {SALES} SELECT id FROM vs",
        "graph_degrees": f"WITH {SALES} SELECT id, count(e.dst) AS degree FROM vs LEFT JOIN e ON e.src = vs.id GROUP BY id",
        "adjacency_text_roundtrip": f"WITH {SUPPLY} SELECT src, dst, weight FROM e",
        "multi_input": f"WITH s AS (WITH {SALES} SELECT id, e.dst FROM vs LEFT JOIN e ON e.src = vs.id), p AS (WITH {SUPPLY} SELECT src AS id, dst FROM e) SELECT id, count(dst) AS degree FROM (SELECT * FROM s UNION ALL SELECT * FROM p) GROUP BY id",
        "hashmin_cc": cc,
        "hashmin_cc_mirror": cc,
        "cc_adjacency": f"WITH RECURSIVE {SALES}, {CC} SELECT cc.id, cc.lab AS color, e.dst AS nbr FROM cc LEFT JOIN e ON e.src = cc.id",
        "sv_cc": cc,
        "svplus_cc": cc,
        "sv_cc_lookup": cc,
        "sv_cc_cyclic": f"WITH RECURSIVE {SUPPLY}, {CC} SELECT id, lab AS component FROM cc",
        "cc_sizes": f"WITH RECURSIVE {SALES}, {CC} SELECT lab AS component, count(*) AS size FROM cc GROUP BY lab",
        "cc_message_report": _message_steps(),
        "pagerank": pagerank,
        "pagerank_mirror": pagerank,
        "sssp": sssp,
        "sssp_mirror": sssp,
        "sssp_weighted": weighted,
        "sssp_weighted_mirror": weighted,
        "fieldbcast_directed": f"WITH {EVENTS} SELECT src AS id, dst AS nbr, dst * 7 AS field FROM e",
        "fieldbcast_undirected": f"WITH {EVENTS} SELECT dst AS id, src AS nbr, src * 7 AS field FROM e",
        "fieldbcast_lookup": f"WITH {SALES} SELECT e.src AS id, e.dst AS nbr, coalesce(CAST(c_nationkey AS bigint), -1) AS field FROM e LEFT JOIN customer ON c_custkey = e.dst",
        "fieldbcast_pushed": f"WITH {VISITS} SELECT e.src AS id, e.dst AS nbr, CASE WHEN f.src IS NULL THEN 0 ELSE e.dst * 7 END AS field FROM e LEFT JOIN e f ON f.src = e.dst AND f.dst = e.src",
        "scc_trim": f"WITH RECURSIVE {VISITS}, ne AS MATERIALIZED (SELECT src, dst FROM e WHERE src <> dst), r(a, b) AS (SELECT src, dst FROM ne UNION SELECT r.a, ne.dst FROM r JOIN ne ON ne.src = r.b), cy AS MATERIALIZED (SELECT a AS id FROM r WHERE a = b) SELECT id, NOT (id IN (SELECT id FROM cy UNION SELECT b FROM r WHERE a IN (SELECT id FROM cy)) AND id IN (SELECT id FROM cy UNION SELECT a FROM r WHERE b IN (SELECT id FROM cy))) AS trimmed FROM vs",
        "scc_minlabel": f"WITH RECURSIVE {MINLABEL} SELECT id, min_forward, min_backward FROM ml",
        "scc_decompose": f"WITH RECURSIVE {MINLABEL} SELECT id, dense_rank() OVER (ORDER BY min_forward, min_backward) - 1 AS color, CAST(CASE WHEN min_forward = min_backward THEN 1 WHEN count(*) OVER (PARTITION BY min_forward, min_backward) <= 3 THEN -1 ELSE 0 END AS integer) AS tag FROM ml",
        "scc": f"WITH RECURSIVE {SCC} SELECT id, component FROM sc",
        "scc_two_rounds": scc_rounds,
        "scc_sizes": f"WITH RECURSIVE {SCC} SELECT component, count(*) AS size FROM sc GROUP BY component",
        "scc_dense": f"WITH RECURSIVE {SCC.replace(VISITS, EVENTS)} SELECT id, component FROM sc",
        "spanning_forest": f"{tree} SELECT id, color, par AS parent FROM b",
        "multi_phase": f"{tree} SELECT id, color, par AS parent FROM b",
        "euler_tour": f"{tree}, {TOUR} SELECT tt.u, tt.v, CASE WHEN nxt IS NULL AND tt.v = color THEN NULL ELSE tt.v END AS next_u, CASE WHEN nxt IS NULL AND tt.v = color THEN NULL ELSE coalesce(nxt, head) END AS next_v, color, forward FROM tt JOIN turn USING (u, v)",
        "list_rank": f"{order} SELECT parent AS u, id AS v, color, 2 * pre - d - 1 AS position, true AS forward FROM ord WHERE parent >= 0 UNION ALL SELECT id, parent, color, 2 * pre - d - 1 + 2 * nd - 1, false FROM ord WHERE parent >= 0",
        "preorder": f"{order} SELECT id, color, pre FROM ord",
        "subtree_size": f"{order} SELECT id, color, nd FROM ord",
        "merge_tree_edges": f"{merged} SELECT u, v, color, pre, nd, nbr_pre, is_tree FROM mt",
        "subtree_minmax": f"{stats} SELECT id, color, parent, pre, nd, mn, mx FROM st",
        "aux_graph": f"{aux} SELECT a, b FROM ax",
        "aux_cc": aux_labels,
        "aux_sv": aux_labels,
        "case1_mark": f"{labels} {marked}",
        "bcc": f"{labels}, mk AS MATERIALIZED ({marked}), bl AS (SELECT label, min({{'u': u, 'v': v}}) AS m FROM mk GROUP BY label) SELECT u, v, m.u AS bcc_u, m.v AS bcc_v FROM mk JOIN bl USING (label)",
        "terasort": items,
        "terasort_prefix": f"SELECT key, concat_ws(' ', rank, content) AS content, rank FROM ({ranked})",
        "terasort_dump": f"SELECT rank, key, content FROM ({ranked})",
        "aggregators": f"WITH {SUPPLY}, d AS (SELECT count(*) AS n FROM e GROUP BY src) SELECT bool_and(n > 0) AS all_linked, CAST(sum(n) AS bigint) AS total, max(n) AS most FROM d",
        "aggregator_count_map": f"WITH {SUPPLY}, d AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src) SELECT id, degree, count(*) OVER (PARTITION BY degree) AS alike FROM d",
        "combiners": f"WITH {EVENTS}, d AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY src) SELECT dst AS id, min(src) AS least, CAST(sum(src) AS bigint) AS total, min({{'degree': degree, 'id': src}}).id AS slowest FROM e JOIN d ON d.id = e.src GROUP BY dst",
        "request_respond": f"WITH {EVENTS}, d AS (SELECT src, count(*) AS n FROM e GROUP BY src) SELECT e.src, e.dst, coalesce(n, 0) * coalesce(n, 0) AS answer FROM e LEFT JOIN d ON d.src = e.dst",
        "request_missing": f"SELECT event_id, target, nation FROM {asks}",
        "request_counters": f"SELECT count(target) AS asked, count(DISTINCT target) AS requests, count(DISTINCT id) AS responses, count(id) > 0 AS has_responses FROM {asks}",
        "missing_targets": f"WITH {SUPPLY} SELECT id, CAST(1 AS bigint) AS got FROM vs",
        "vertex_add": f"WITH {SUPPLY} SELECT id, CAST(0 AS bigint) AS got FROM vs UNION ALL SELECT 9000000000000 + id % 10, count(*) FROM vs GROUP BY id % 10",
        "force_terminate": f"WITH {SALES} SELECT vs.id, least(vs.id, min(e.src)) AS label FROM vs LEFT JOIN e ON e.dst = vs.id GROUP BY vs.id",
        "wake_all": f"WITH {SUPPLY} SELECT id, CAST(3 AS bigint) AS computed FROM vs",
        "put_fastq": "SELECT 'ACGT' || c_custkey AS value FROM customer",
        "put_dir": f"WITH {EVENTS} SELECT id, count(e.dst) AS degree FROM vs LEFT JOIN e ON e.src = vs.id GROUP BY id",
    }
