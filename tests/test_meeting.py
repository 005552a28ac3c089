"""Rows that meet: what ties them, what is sent to all tasks, and what their union needs."""

import random

from pyspark.sql import functions as F

from mapsmith.functions import geometry as g
from mapsmith.operators import spatial as sp
from mapsmith.operators.components import FEW_EDGES, components
from mapsmith.plans.cutting import cut


def boxes(spark, rows):
    g.install(spark)
    made = spark.createDataFrame(rows, "k long, cls string, a double, b double, c double, d double")
    return made.select(F.col("k").cast("string").alias("fid"), "cls", F.array("k").alias("_ord"), g.rectangle(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("geom"))


def scattered(n, side, most):
    r = random.Random(7)
    at = [(r.randrange(side), r.randrange(side), r.randrange(1, most), r.randrange(1, most)) for _ in range(n)]
    return [(k + 100, "ab"[k % 2], float(x), float(y), float(x + w), float(y + h)) for k, (x, y, w, h) in enumerate(at)]


def test_groups_are_those_of_all_pairs(spark):
    rows = scattered(300, 300, 14)
    for by in (None, ["cls"]):
        up = {r[0]: r[0] for r in rows}

        def root(k):
            while up[k] != k:
                k = up[k]
            return k

        for a in rows:
            for b in rows:
                if a[2] <= b[4] and b[2] <= a[4] and a[3] <= b[5] and b[3] <= a[5] and (not by or a[1] == b[1]):
                    low, high = sorted((root(a[0]), root(b[0])))
                    up[high] = low
        out = sp.meeting(boxes(spark, rows), by=by).collect()
        assert len(out) == len(rows)
        assert {r["_ord"][0]: r["_comp"][0] for r in out} == {k: root(k) for k in up}


def test_the_graph_grows_with_cells_not_rows(spark, monkeypatch):
    """Before, each row gave an edge for each of its cells."""
    edges = []
    monkeypatch.setattr(sp, "components", lambda e, a, b: (edges.append(e.select(a, b).distinct().count()), components(e, a, b))[1])
    out = sp.union_parts(boxes(spark, scattered(2000, 100, 30)))
    assert out.count() == 1 and edges[0] < 400


def test_tiles_of_one_component_go_to_several_tasks(spark, monkeypatch):
    """Before, where the large components were not broadcast, their rows stayed in one task."""
    monkeypatch.setattr(sp, "AT_ONCE", 20)
    seen = []
    monkeypatch.setattr(sp, "cut", lambda df, name: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()) if name == "tiles" else None, cut(df, name))[1])
    sp.union_parts(boxes(spark, scattered(500, 100, 30))).count()
    assert any("RepartitionByExpression [_comp" in plan and "_ty" in plan for plan in seen)


def test_inner_shapes_do_not_change_a_union(spark):
    """What lies inside another shape goes before the union; what reaches its rim, or lies in its hole, stays."""
    g.install(spark)
    donut = "POLYGON ((0 0, 100 0, 100 100, 0 100, 0 0), (40 40, 60 40, 60 60, 40 60, 40 40))"
    inner = [f"POLYGON (({x} {y}, {x + 3} {y}, {x + 3} {y + 3}, {x} {y + 3}, {x} {y}))" for x in range(1, 97, 5) for y in range(0, 97, 5)]
    hole = "POLYGON ((45 45, 50 45, 50 50, 45 50, 45 45))"
    df = spark.createDataFrame([(w,) for w in [donut, hole, *inner]], "w string").select(g.from_wkt("w").alias("geom"))
    few = df.agg(g.area(g.union(F.collect_list("geom"))).alias("a"), F.size(g.vertices(g.union(F.collect_list("geom")))).alias("n")).head()
    plain = df.agg(F.array_sort(F.collect_list("geom")).alias("gs")).select(F.aggregate("gs", F.col("gs")[0], lambda u, x: g.union(F.array(u, x))).alias("u")).select(g.area("u").alias("a"), F.size(g.vertices("u")).alias("n")).head()
    assert few == plain


def test_few_and_many_edges_give_the_same_components(spark, monkeypatch):
    r = random.Random(3)
    edges = spark.createDataFrame([(r.randrange(200), r.randrange(200)) for _ in range(120)], "a long, b long")
    named = edges.select(F.array("a", F.lit(1).cast("long")).alias("a"), F.array("b", F.lit(1).cast("long")).alias("b"))
    texts = edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"))
    assert edges.count() <= FEW_EDGES
    from mapsmith.operators import components as module

    for e in (edges, named, texts):
        few = {str(x["node"]): str(x["component"]) for x in components(e, "a", "b").collect()}
        with monkeypatch.context() as m:
            m.setattr(module, "FEW_EDGES", 0)
            assert {str(x["node"]): str(x["component"]) for x in components(e, "a", "b").collect()} == few
