"""Small cases with known results."""

import pytest
from pyspark.sql import functions as F

from mapsmith.algorithms import ALGORITHMS, areas, lines
from mapsmith.functions import geometry as g
from mapsmith.operators import features as fe
from mapsmith.operators import network as nw
from mapsmith.operators import points as pt
from mapsmith.operators import spatial as sp
from mapsmith.operators.model import Features, GeoCombineError, GeometryTypeError, InvalidCRSError, MissingReferenceError, combine


def table(spark, *wkts, **columns):
    g.install(spark)
    rows = [(str(i), [i], w, *(c[i] for c in columns.values())) for i, w in enumerate(wkts)]
    df = spark.createDataFrame(rows, "fid string, _ord array<long>, w string" + "".join(f", {c} {'long' if isinstance(v[0], int) else 'double' if isinstance(v[0], float) else 'string'}" for c, v in columns.items()))
    return df.withColumn("geom", g.from_wkt("w")).drop("w")


def test_dbscan(spark):
    df = pt.xy(table(spark, "POINT (0 0)", "POINT (0.5 0)", "POINT (2 0)"))
    assert {r["fid"]: r["cluster"] for r in pt.cluster_ids(df, 1.0).collect()} == {"0": 0, "1": 0, "2": -1}


def test_centroid_is_inclusive(spark):
    r = pt.cluster_centroids(table(spark, "POINT (100 100)", "POINT (101 100)"), 1.0).select(g.wkt("geom").alias("w"), "old_ids").head()
    assert r["w"] == "POINT (100.5 100)" and r["old_ids"] == ["0", "1"]


def test_displacement(spark):
    got = lambda *p: [r["w"] for r in pt.displace(table(spark, *p), 1.0, 1).orderBy("_ord").select(g.wkt("geom").alias("w")).collect()]
    assert got("POINT (0 0)", "POINT (0.5 0)") == ["POINT Z (-0.25 0 0)", "POINT Z (0.75 0 0)"]
    assert got("POINT (0 0)", "POINT (1 0)") == ["POINT Z (0 0 0)", "POINT Z (1 0 0)"]
    assert got("POINT (0 0)", "POINT (0 0)") == ["POINT Z (0 0 0)"] * 2


def test_greedy_reduction(spark):
    df = table(spark, *(f"POINT ({i} 0)" for i in range(5)), p=[1, 2, 3, 4, 5])
    assert [r["fid"] for r in pt.reduce_by_selecting(df, None, 1.5, "p").collect()] == ["4"]


def test_coverage(spark):
    out = sp.coverage(table(spark, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"), table(spark, "POLYGON ((0 0, 3 0, 3 3, 0 3, 0 0))"), "c")
    assert out.head()["c"] == pytest.approx(56.25)


def test_edge_adjacency(spark):
    square = table(spark, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))")
    all_round = table(spark, "POLYGON ((-9 -9, 13 -9, 13 13, -9 13, -9 -9))")
    far = table(spark, "POLYGON ((90 90, 91 90, 91 91, 90 91, 90 90))")
    assert sp.edge_adjacency(square, all_round, 1.0, "r").head()["r"] == pytest.approx(1.0)
    assert sp.edge_adjacency(square, far, 1.0, "r").head()["r"] == 0.0


def test_line_merge(spark):
    df = table(spark, "LINESTRING (0 0, 1 0)", "LINESTRING (1 0, 2 0)", "LINESTRING (2 0, 3 0)", a=["x", "x", "x"])
    r = nw.merge_by_attribute(df, "a").select("old_ids", g.length("geom").alias("n")).collect()
    assert len(r) == 1 and r[0]["old_ids"] == ["0", "1", "2"] and r[0]["n"] == 3


def test_dissolve(spark):
    df = table(spark, "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", "POLYGON ((1 0, 2 0, 2 1, 1 1, 1 0))", "POLYGON ((2 1, 3 1, 3 2, 2 2, 2 1))", c=["a", "a", "a"])
    got = {tuple(r["old_ids"]): r["a"] for r in sp.dissolve(df).select("old_ids", g.area("geom").alias("a")).collect()}
    assert got == {("0", "1"): 2.0, ("2",): 1.0}  # a single shared point does not join
    assert sp.dissolve(df.withColumn("c", F.lit(None).cast("string")), by=["c"]).count() == 0


def test_groups_meet_in_points_too(spark):
    df = table(spark, "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", "POLYGON ((9 9, 10 9, 10 10, 9 10, 9 9))", "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))")
    assert [r["n"] for r in sp.group_by_intersections(df, "n").orderBy("_ord").collect()] == [1, 2, 1]


def test_hash_vectors(spark):
    df = table(spark, "POINT (0 0)", "POINT (0 0)").withColumn("fid", F.lit("1"))
    assert {r["fid"][:8] for r in fe.hash_duplicates(df, "test").collect()} == {"3d5dd0c0"}
    old = df.limit(1).withColumn("old_ids", F.array(F.lit("9"), F.lit("10")))
    assert fe.hash_old_ids(old, "test").head()["fid"].startswith("6d54142c")
    with pytest.raises(TypeError):
        fe.hash_old_ids(df, "test", "fid")


def test_contract(spark):
    squares = table(spark, "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))")
    named = Features(squares.withColumnsRenamed({"geom": "shape", "fid": "own"}), "shape", "own")
    out = areas.DissolvePolygons().execute(named)
    assert {"shape", "own"} <= set(out.df.columns) and out.df.count() == 1
    points = Features(table(spark, "POINT (0 0)"))
    with pytest.raises(GeometryTypeError):
        areas.DissolvePolygons().execute(points, strict=True)
    with pytest.raises(Exception, match="not accepted"):
        areas.DissolvePolygons().execute(points).df.collect()
    with pytest.raises(MissingReferenceError, match="Reference data is missing."):
        lines.GeneralizeSlopeLines().execute(points)
    with pytest.raises(InvalidCRSError):
        lines.GeneralizeRoads().execute(Features(table(spark, "LINESTRING (0 0, 1 1)"), crs=4326))
    with pytest.raises(ValueError):
        lines.GeneralizeRoads(threshold_length=-1)
    with pytest.raises(ValueError):
        lines.GeneralizeRoads().threshold_length = 3
    assert lines.GeneralizeRoads(unknown=1).threshold_length == 75
    with pytest.raises(GeoCombineError):
        combine([])
    with pytest.raises(GeoCombineError):
        combine([points, Features(points.df, crs=4326)])
    assert len(ALGORITHMS) == 19


def test_empty_tables(spark):
    none = Features(table(spark, "POINT (0 0)").limit(0))
    assert lines.GeneralizePoints().execute(none).df.count() == 0
    assert lines.GeneralizeRoads().execute(Features(table(spark, "LINESTRING (0 0, 1 1)").limit(0))).df.count() == 0


def test_dense_points_have_the_same_clusters(spark, monkeypatch):
    """By links between cells, what all pairs give."""
    import random

    rng = random.Random(3)
    wkts = [f"POINT ({rng.gauss(0, 1):.3f} {rng.gauss(0, 1):.3f})" for _ in range(200)] + [f"POINT ({rng.uniform(-30, 30):.2f} {rng.uniform(-30, 30):.2f})" for _ in range(200)] + ["POINT (100 100)", "POINT (101 100)", "POINT (102.001 100)"]
    df = pt.xy(table(spark, *wkts))
    for eps in (1.0, 2.5):
        monkeypatch.setattr(pt, "DENSE", 10_000)
        want = {r["fid"]: r["cluster"] for r in pt.cluster_ids(df, eps).collect()}
        monkeypatch.setattr(pt, "DENSE", 1)
        assert {r["fid"]: r["cluster"] for r in pt.cluster_ids(df, eps).collect()} == want
    assert want["400"] == want["401"] != -1


def test_large_components_are_united_by_tile(spark, monkeypatch):
    wkts = [f"POLYGON (({i} {j}, {i + 1} {j}, {i + 1} {j + 1}, {i} {j + 1}, {i} {j}))" for i in range(12) for j in range(12) if (i, j) != (5, 5)] + ["POLYGON ((50 50, 51 50, 51 51, 50 50))"]
    df = table(spark, *wkts)
    plain = sorted(r["a"] for r in sp.union_parts(df).select(g.area("geom").alias("a")).collect())
    monkeypatch.setattr(sp, "AT_ONCE", 20)
    tiled = sorted(r["a"] for r in sp.union_parts(df).select(g.area("geom").alias("a")).collect())
    assert tiled == plain == [0.5, 143.0]
    assert sorted((len(r["old_ids"]), r["a"]) for r in sp.dissolve(df).select("old_ids", g.area("geom").alias("a")).collect()) == [(1, 0.5), (143, 143.0)]
