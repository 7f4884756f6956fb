"""Joins with counted sides, running totals over ranges, hub coverage: against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from auditloom.operators import graph, sized


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize(("small", "hot"), [(100, 10), (1, 20), (0, 20)])
def test_sized_join_keeps_all_rows(spark, monkeypatch, how, small, hot):
    monkeypatch.setattr(sized, "HOT_ROWS", hot)
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "b", "c", None]), i) for i in range(120)]
    values = {"a": 1, "c": 2, "d": 3}
    got = sized.sized_join(spark.createDataFrame(rows, "k string, i int"), spark.createDataFrame(list(values.items()), "k string, v int"), "k", how, small)
    want = [(k, i, values.get(k)) for k, i in rows if k in values or how == "left"]
    assert sorted(map(str, got.select("k", "i", "v").collect())) == sorted(map(str, spark.createDataFrame(want, "k string, i int, v int").collect()))


def test_running_total_over_ranges(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["big"] * 9 + ["x", "y", None]), i, rnd.randrange(5), "e") for i in range(2_000)]
    got = sized.running_total(spark.createDataFrame(rows, "g string, i int, v int, _x string").repartition(7), "g", [F.col("i").asc()], F.col("v"))
    assert got.columns == ["g", "i", "v", "_x", "before"]
    total, want = {}, {}
    for g, i, v, _ in rows:
        want[i] = total.get(g, 0)
        total[g] = want[i] + v
    assert {r.i: r.before for r in got.collect()} == want
    assert sized.running_total(spark.createDataFrame([], "g string, i int, v int"), "g", [F.col("i").asc()], F.col("v")).count() == 0


def test_hub_coverage(spark):
    rnd = random.Random(3)
    path = lambda: "/" + "/".join(rnd.choice("abc") for _ in range(rnd.randrange(4)))
    nodes = {("g" if rnd.random() < 0.8 else "h", path()) for _ in range(60)} | {("g", "/")}
    edges = {(g, n, rnd.choice(sorted(nodes))[1]) for g, n in nodes for _ in range(3)} | {("g", "/a", "/gone")}
    hubs = {(g, n, n.rstrip("/") + "/") for g, n in nodes} | {("g", "/missing", "/a/"), ("g", "/b", "/a/"), ("g", "/a", "/none/")}
    frame = lambda rows, names: spark.createDataFrame(sorted(rows), ", ".join(f"{c} string" for c in names.split()))
    got = graph.hub_coverage(frame(nodes, "graph node"), frame(edges, "graph src dst"), frame(hubs, "graph hub prefix"), 2)
    want = {}
    for g, hub, prefix in hubs:
        below = {n for h, n in nodes if h == g and n.startswith(prefix) and n != hub}
        if (g, hub) in nodes and below:
            linked = below & {d for h, s, d in edges if (h, s) == (g, hub)}
            want[g, hub, prefix] = (len(below), len(linked), len(below - linked), sorted(below - linked)[:2])
    assert {(r.graph, r.hub, r.prefix): (r.pages, r.linked, r.missing, r.examples) for r in got.collect()} == want
