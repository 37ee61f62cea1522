import random

import pytest
from compare import assert_same

from loglattice.plans import files as _files  # noqa: F401
from loglattice.plans import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_equals_duckdb(spark, name):
    assert_same(spark, engine.queries()[name], engine.oracle_sql()[name], SF)


def test_clusters_equal_union_find(spark):
    from loglattice.operators import graph
    from loglattice.plans.telemetry import telemetry

    ev = telemetry(spark, SF)
    rows = ev.select(graph.entities().alias("e")).collect()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r in rows:
        keys = [f"{e['kind']}:{e['value']}" for e in r["e"]]
        for k in keys:
            a, b = find(keys[0]), find(k)
            parent[max(a, b)] = min(a, b)
    star = ev.select(graph.entities().alias("e")).filter("size(e) > 0").selectExpr("transform(e, x -> x.kind || ':' || x.value) as k").selectExpr("k[0] as a", "explode(k) as b").distinct()
    got = {r["node"]: r["root"] for r in graph.components(star).collect()}
    assert got == {k: find(k) for k in parent}
    sizes = [r["entities"] for r in graph.incident_clusters(ev).collect()]
    assert sizes and all(s >= 2 for s in sizes)


def test_components_kept_up_to_date_equal_a_full_run(spark, tmp_path):
    from loglattice.operators import graph

    rng = random.Random(7)
    kept = graph.Components(spark, str(tmp_path / "kept"))
    links = []
    for _ in range(5):
        batch = [(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(9)] + [(f"alone{rng.randrange(9)}",) * 2]
        links += batch
        kept.add(spark.createDataFrame(batch, "a string, b string"))
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                x = parent[x]
            return x

        for a, b in links:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        rows = kept.current().collect()
        assert {r.node: r.root for r in rows} == {k: find(k) for k in list(parent)} and len(rows) == len(parent)
    nodes, moved = kept.state()
    kept.add(spark.createDataFrame([], "a string, b string"))
    assert kept.current().count() == nodes.count() and moved.filter("grp = root").count() == 0
