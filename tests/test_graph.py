from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codeloam.operators import graph

SCHEMA = "project string, src string, dst string, edge_ord int"


def python_bfs(edges, seeds, hops, direction, most=60):
    first = {}
    for s, d, o in edges:
        if s and d:
            first.setdefault((s, d), o)
            first[s, d] = min(first[s, d], o)
    out, back = {}, {}
    for (s, d), o in first.items():
        out.setdefault(s, []).append((o, d))
        back.setdefault(d, []).append((o, s))
    order = list(dict.fromkeys(seeds))[:most]
    frontier = list(order)
    for _ in range(hops):
        found = {}
        for parent, x in enumerate(frontier):
            for way, table in ((0, out), (1, back)):
                if direction == "both" or direction == ("out", "in")[way]:
                    for o, y in table.get(x, ()):
                        found.setdefault(y, (parent, way, o))
                        found[y] = min(found[y], (parent, way, o))
        fresh = sorted((k, y) for y, k in found.items() if y not in order)
        frontier = [y for _, y in fresh][: max(0, most - len(order))]
        order += frontier
    return order


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh"), st.integers(0, 30)), max_size=25), st.lists(st.sampled_from("abch"), min_size=1, max_size=3), st.sampled_from(["out", "in", "both"]), st.integers(1, 3))
def test_bfs_equals_python(spark, edges, seeds, direction, hops):
    e = spark.createDataFrame([("p", *x) for x in edges], SCHEMA)
    s = spark.createDataFrame([("p", x, i) for i, x in enumerate(seeds)], "project string, symbol string, ord int")
    got = [r["symbol"] for r in graph.expand_graph(e, s, hops, direction).orderBy("pos").collect()]
    assert got == python_bfs(edges, seeds, hops, direction)


def test_nulls_loops_and_the_limit(spark):
    rows = [("p", "a", f"n{i:03}", i) for i in range(100)] + [("p", None, "x", 1), ("p", "a", None, 2), ("p", "a", "a", 3), ("p", "toString", "constructor", 1), ("q", "a", "other", 0)]
    e = spark.createDataFrame(rows, SCHEMA)
    s = spark.createDataFrame([("p", "a", 0)], "project string, symbol string, ord int")
    got = graph.expand_graph(e, s, 1, "out").orderBy("pos").collect()
    assert len(got) == 60 and [r["symbol"] for r in got[:3]] == ["a", "n000", "n001"]
    assert graph.adjacency(e).where("symbol = 'toString'").first()["callees"] == ["constructor"]
    d = {(r["project"], r["symbol"]): (r["out_degree"], r["in_degree"]) for r in graph.degrees(e).collect()}
    assert d["p", "a"] == (101, 1) and ("p", "x") not in d


def test_empty_tables(spark):
    e = spark.createDataFrame([], SCHEMA)
    s = spark.createDataFrame([("p", "a", 0)], "project string, symbol string, ord int")
    assert [r["symbol"] for r in graph.expand_graph(e, s).collect()] == ["a"]
    assert graph.degrees(e).count() == graph.adjacency(e).count() == 0
    assert graph.retrieval_expand(e, s).count() == 0
