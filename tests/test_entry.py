import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = (
    "multi_input", "svplus_cc", "cc_message_report", "sssp", "fieldbcast_lookup", "fieldbcast_pushed", "scc_two_rounds",
    "preorder", "bcc", "terasort_prefix", "terasort_dump", "aggregator_count_map", "combiners", "request_missing",
    "request_counters", "missing_targets", "vertex_add", "force_terminate",
)


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events", "customer", "supplier"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: str(r)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=key) == sorted(want.fetchall(), key=key)


def test_forest_query_against_kruskal(spark):
    """msf has no SQL on whole tables; here the whole query meets plain Python."""
    con = duckdb.connect()
    sql = f"select l_partkey, 1000000000 + l_suppkey, min(cast(l_quantity * 100 + l_linenumber as bigint)) from '{SF}/lineitem.parquet' group by 1, 2"
    edges = sorted((w, max(a, b), min(a, b)) for a, b, w in con.execute(sql).fetchall())
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    want = []
    for w, hi, lo in edges:
        if find(lo) != find(hi):
            root[find(hi)] = find(lo)
            want.append((lo, hi, w))
    assert sorted(map(tuple, entry.queries()["msf"](spark, SF).select("u", "v", "weight").collect())) == sorted(want)
