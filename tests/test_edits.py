"""Edits of shapes, row order, and what the new operators do at the edges of their domain."""

import pytest
from pyspark.sql import functions as F

from mapsmith.algorithms import areas, lines
from mapsmith.functions import geometry as g
from mapsmith.operators import features as fe
from mapsmith.operators import network as nw
from mapsmith.operators import spatial as sp
from mapsmith.operators.components import components
from mapsmith.operators.model import Features, combine, ord_part, ord_under
from tests.test_operators import table


def wkts(df, column="geom"):
    return [r["w"] for r in df.select(g.wkt(column).alias("w")).collect()]


def one(spark, expression):
    g.install(spark)
    return spark.range(1).select(expression.alias("v")).head()["v"]


def w(text):
    return g.from_wkt(F.lit(text))


# row order --------------------------------------------------------------------------------------------------------


def test_parts_of_parts_keep_their_order_whatever_the_partition(spark):
    df = table(spark, "MULTIPOINT ((0 0), (1 1))", "MULTIPOINT ((2 2), (3 3))").withColumn("_ord", F.array((F.lit(1) + F.col("_ord")[0]) * F.lit(64 * (1 << 33))))
    for _ in range(4):  # what was a shift of bits overflowed after two
        df = sp.explode_parts(df)
    assert wkts(df.orderBy("_ord")) == [f"POINT ({i} {i})" for i in range(4)]
    assert [len(r["_ord"]) for r in df.collect()] == [5] * 4


def test_more_parts_than_a_few_thousand_do_not_run_into_the_next_row(spark):
    many = "MULTIPOINT (" + ", ".join(f"({i} 0)" for i in range(5000)) + ")"
    out = sp.explode_parts(table(spark, many, "POINT (-1 0)")).orderBy("_ord")
    assert out.select("fid").collect()[-1]["fid"] == "1" and out.select("_ord").distinct().count() == 5001


def test_orders_of_united_tables(spark):
    a, b = table(spark, "POINT (0 0)"), table(spark, "POINT (1 1)", "POINT (2 2)")
    out = combine([Features(b), Features(a)]).df.orderBy("_ord")
    assert wkts(out) == ["POINT (0 0)"] * 0 + ["POINT (1 1)", "POINT (2 2)", "POINT (0 0)"]
    both = a.withColumn("_ord", ord_under(1)).unionByName(b.withColumn("_ord", ord_under(0, ord_part(F.lit(7)))))
    assert wkts(both.orderBy("_ord")) == ["POINT (1 1)", "POINT (2 2)", "POINT (0 0)"]


def test_rows_that_share_an_id_are_matched_one_by_one(spark):
    squares = table(spark, "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", "POLYGON ((9 9, 10 9, 10 10, 9 10, 9 9))").withColumn("fid", F.lit("same"))
    held, free = sp.split_by_points(squares, table(spark, "POINT (0.5 0.5)"))
    assert held.count() == free.count() == 1
    assert sorted(r["c"] for r in sp.coverage(squares, squares.limit(1).select("geom"), "c").collect()) == [0.0, 100.0]
    assert sp.nearest_other(squares, squares, 50.0).where("_dist > 11").count() == 2
    water = table(spark, "POLYGON ((1 -5, 5 -5, 5 6, 1 6, 1 -5))")
    assert sorted(round(r["r"], 2) > 0 for r in sp.edge_adjacency(squares, water, 0.5, "r").collect()) == [False, True]


def test_single_numbers_are_taken_as_orders(spark):
    df = table(spark, "POINT (0 0)", "POINT (1 1)").withColumn("_ord", F.col("_ord")[0])
    assert Features(df).df.schema["_ord"].dataType.simpleString() == "array<bigint>"
    assert Features(df.drop("_ord")).df.select("_ord").distinct().count() == 2


def test_components_of_names_and_lists(spark):
    edges = spark.createDataFrame([("b", "a"), ("b", "c"), ("x", "y")], "src string, dst string")
    assert {(r["node"], r["component"]) for r in components(edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    lists = spark.createDataFrame([([2, 1], [1, 9]), ([1], [1, 0])], "src array<long>, dst array<long>")
    assert {(tuple(r["node"]), tuple(r["component"])) for r in components(lists).collect()} == {((2, 1), (1, 9)), ((1, 9), (1, 9)), ((1,), (1,)), ((1, 0), (1,))}


# heights ----------------------------------------------------------------------------------------------------------


def test_nearest_z(spark):
    source = table(spark, "POINT Z (0 0 5)", "POINT Z (100000 0 7)", "POINT (3 3)")
    got = wkts(sp.nearest_z(table(spark, "LINESTRING (1 0, 60000 0)", "LINESTRING Z (1 0 2, 2 0 3)", "POLYGON ((0 0, 1 0, 1 1, 0 0))"), source).orderBy("_ord"))
    assert got == ["LINESTRING Z (1 0 5, 60000 0 7)", "LINESTRING Z (1 0 2, 2 0 3)", "POLYGON Z ((0 0 5, 1 0 5, 1 1 5, 0 0 5))"]
    flat = table(spark, "POINT (1 1)")
    assert wkts(sp.nearest_z(flat, flat)) == ["POINT (1 1)"]  # nothing to take a z from
    assert wkts(sp.nearest_z(flat, source.limit(0))) == ["POINT (1 1)"]
    assert sp.nearest_z(flat.limit(0), source).count() == 0
    over = sp.nearest_z(table(spark, "POINT Z (0 0 1)"), source, overwrite=True)
    assert wkts(over) == ["POINT Z (0 0 5)"]


# lines ------------------------------------------------------------------------------------------------------------


def test_split(spark):
    pieces = lambda a, b: one(spark, F.transform(g.call("split", w(a), w(b)), lambda x: g.wkt(x)))
    ring = "LINESTRING (0 0, 10 0, 10 10, 0 10, 0 0)"
    assert pieces(ring, "POINT (5 0)") == [ring]
    assert pieces(ring, "MULTIPOINT ((0 0), (10 10))") == ["LINESTRING (0 0, 10 0, 10 10)", "LINESTRING (10 10, 0 10, 0 0)"]
    assert pieces(ring, "LINESTRING (5 -1, 5 11)") == ["LINESTRING (5 0, 10 0, 10 10, 5 10)", "LINESTRING (5 10, 0 10, 0 0, 5 0)"]
    assert pieces("LINESTRING (0 0, 4 0)", "POLYGON ((1 -1, 2 -1, 2 1, 1 1, 1 -1))") == ["LINESTRING (0 0, 1 0)", "LINESTRING (1 0, 2 0)", "LINESTRING (2 0, 4 0)"]
    assert pieces("LINESTRING (0 0, 4 0)", "POINT (0 0)") == ["LINESTRING (0 0, 4 0)"]


def test_parts_by_size(spark):
    small = g.wkt(g.with_double("largerthan", w("MULTILINESTRING ((0 0, 1 0), (0 5, 9 5))"), 2))
    assert one(spark, small) == "LINESTRING (0 5, 9 5)"
    assert one(spark, g.is_empty(g.with_double("largerthan", w("POLYGON ((0 0, 1 0, 1 1, 0 0))"), 5)))
    for bad in ("POINT (0 0)", "GEOMETRYCOLLECTION (LINESTRING (0 0, 1 1))"):
        with pytest.raises(Exception, match="size|collections"):
            one(spark, g.wkt(g.call("largest", w(bad))))


def test_vertices_on_segments(spark):
    add = lambda line, p, t=0.0: one(spark, g.wkt(g.call("addpoints", w(line), F.array(w(p)), F.lit(t))))
    assert add("LINESTRING (0 0, 10 0)", "POINT (4 0)") == "LINESTRING (0 0, 4 0, 10 0)"
    assert add("LINESTRING (0 0, 10 0)", "POINT (4 1)") == "LINESTRING (0 0, 10 0)"
    assert add("LINESTRING (0 0, 10 0)", "POINT (4 1)", 2.0) == "LINESTRING (0 0, 4 1, 10 0)"
    assert add("LINESTRING Z (0 0 0, 10 0 10)", "POINT Z (4 0 50)") == "LINESTRING Z (0 0 0, 4 0 50, 10 0 10)"
    with pytest.raises(Exception, match="tolerance"):
        add("LINESTRING (0 0, 10 0)", "POINT (4 0)", -1.0)


def test_joint_curve_is_a_spline_through_the_joint(spark):
    df = table(spark, "LINESTRING (0 0, 100 0)", "LINESTRING (100 0, 100 100)", "LINESTRING (500 500, 600 500)")
    out = nw.smooth_connections(df, distance=30, subdivisions=10).orderBy("_ord").collect()
    a, b, c = ([tuple(p[:2]) for p in r["v"]] for r in nw.smooth_connections(df, distance=30, subdivisions=10).orderBy("_ord").select(g.vertices("geom").alias("v")).collect())
    assert len(out) == 3 and a[0] == (0, 0) and b[-1] == (100, 100) and c == [(500, 500), (600, 500)]
    assert a[1] == (70, 0) and b[-2] == (100, 30) and a[-1] == b[0] == (100, 0)
    # a corner is rounded outwards, the same on either side of it
    assert all(abs(p[0] - (100 - q[1])) < 1e-9 and abs(p[1] - (100 - q[0])) < 1e-9 for p, q in zip(a[1:], b[:-1][::-1], strict=True))
    assert min(p[1] for p in a[1:-1]) < -0.5
    with pytest.raises(ValueError):
        nw.smooth_connections(df, distance=0)
    star = table(spark, "LINESTRING (0 0, 9 0)", "LINESTRING (0 0, 0 9)", "LINESTRING (0 0, -9 0)")
    assert {r["n"] for r in nw.smooth_connections(star, distance=3).select(F.size(g.vertices("geom")).alias("n")).collect()} == {2}


def test_rank_parallel(spark):
    far = "LINESTRING (0 0, 4000 0)", "LINESTRING (4000 300000, 0 300000)", "LINESTRING (0 100000, 4000 100000)", "LINESTRING (25000 50, 25010 50)"
    out = lines.rank_parallel(table(spark, *far, c=["a"] * 4), "c").collect()
    ranks = {r["fid"]: r["_rank"] for r in out}
    # the middle lies off the fourth line; the others reach over more than 100 km
    assert ranks["3"] is None and sorted((ranks["0"], ranks["2"], ranks["1"])) == [1, 2, 3] and ranks["2"] == 2
    two = {r["fid"]: r["_rank"] for r in lines.rank_parallel(table(spark, *far[:2], c=["a"] * 2), "c").collect()}
    assert two == {"0": 0, "1": 1}


def test_parallel_segments_in_either_sense(spark):
    pairs = lambda *ls: lines.parallel_segments(table(spark, *ls), 10.0, 10.0)[1].count()
    assert pairs("LINESTRING (0 0, 100 0)", "LINESTRING (0 5, 100 5)") == 2
    assert pairs("LINESTRING (0 0, 100 0)", "LINESTRING (100 5, 0 5)") == 2
    assert pairs("LINESTRING (0 0, 100 0)", "LINESTRING (0 2, 100 -2)") == 0  # they cross
    assert pairs("LINESTRING (0 0, 100 0)", "LINESTRING (0 15, 100 15)") == 0
    assert pairs("LINESTRING (0 0, 100 0)", "LINESTRING (108 0, 200 0)") == 0  # the buffer ends flat


def test_nearest_wall_at_any_distance(spark):
    df, wall = table(spark, "LINESTRING (0 0, 10 0)"), table(spark, "LINESTRING (50000 -9, 50000 9)")
    out = nw.extend_flagged(df, wall, F.lit(False), F.lit(True))
    assert wkts(out) == ["LINESTRING (0 0, 10 0, 50000 0)"]
    assert wkts(nw.extend_flagged(df, wall, F.lit(False), F.lit(True), 100.0)) == ["LINESTRING (0 0, 10 0)"]
    assert wkts(nw.extend_flagged(df, wall.limit(0), F.lit(True), F.lit(True))) == ["LINESTRING (0 0, 10 0)"]


# areas ------------------------------------------------------------------------------------------------------------


def test_faces_have_ids_of_their_own(spark):
    out = nw.faces(table(spark, "LINESTRING (0 0, 1 0, 1 1, 0 1, 0 0)", "LINESTRING (1 0, 5 0)", "LINESTRING (5 0, 6 0, 6 1, 5 1, 5 0)")).collect()
    assert len({r["fid"] for r in out}) == len({tuple(r["_ord"]) for r in out}) == 2


def test_squared_buildings(spark):
    squared = lambda text, t: one(spark, g.wkt(g.call("norm", g.with_double("squared", w(text), t))))
    step = "POLYGON ((0 0, 50 0, 50 20, 30 20, 30 22, 0 22, 0 0))"
    assert squared(step, 5) == one(spark, g.wkt(g.call("norm", w("POLYGON ((0 0, 50 0, 50 22, 0 22, 0 0))"))))
    cut_corner = "POLYGON ((0 0, 50 0, 50 28, 48 30, 0 30, 0 0))"
    assert squared(cut_corner, 5) == one(spark, g.wkt(g.call("norm", w("POLYGON ((0 0, 50 0, 50 30, 0 30, 0 0))"))))
    assert squared(step, 1) == one(spark, g.wkt(g.call("norm", w(step))))
    assert one(spark, g.area(g.with_double("squared", w("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"), 5))) == 4.0


def test_thin_sections(spark):
    df = table(spark, "POLYGON ((0 0, 400 0, 400 10, 0 10, 0 0))")
    thin, rest = areas.thin_to_lines(df, 20.0, 50.0, 60.0)
    got = thin.select(g.length("geom").alias("n"), "old_ids").collect()
    assert rest.count() == 0 and len(got) == 1 and 385 < got[0]["n"] < 415 and got[0]["old_ids"] == ["0"]
    thin, rest = areas.thin_to_lines(table(spark, "POLYGON ((0 0, 100 0, 100 90, 0 90, 0 0))"), 20.0, 50.0, 60.0)
    assert thin.count() == 0 and rest.count() == 1


def test_narrow_parts_keep_every_row(spark):
    out = fe.narrow_parts(table(spark, "POLYGON ((0 0, 50 0, 50 50, 0 50, 0 0))", "POLYGON ((90 0, 94 0, 94 50, 90 50, 90 0))"), 10)
    assert [r["a"] for r in out.orderBy("_ord").select(g.area("geom").alias("a")).collect()] == [0.0, pytest.approx(200)]


def test_shore_is_split_where_it_was(spark):
    lake = table(spark, "POLYGON ((0 0, 100 0, 100 100, 0 100, 0 0))")
    old = table(spark, "LINESTRING (0 0, 100 0, 100 50)", "LINESTRING (100 50, 100 100, 0 100)", c=["sand", "rock"])
    tool = areas.GeneralizeWaterAreas()
    out = tool._shoreline(lake, old, sp.unmatched_segments(lake, old).select("geom"))
    assert sorted((r["c"], r["n"]) for r in out.select("c", g.length("geom").alias("n")).collect()) == [("rock", 150.0), ("sand", 150.0)]


def test_whole_algorithms_keep_their_promises(spark):
    """No repeated id, nothing empty, z everywhere where the input has it, single parts."""
    squares = table(spark, *(f"POLYGON Z (({i * 60} 0 {i}, {i * 60 + 55} 0 {i}, {i * 60 + 55} 55 {i}, {i * 60} 55 {i}, {i * 60} 0 {i}))" for i in range(6)), cls=["a"] * 6)
    water = Features(table(spark, "POLYGON ((-500 -900, 900 -900, 900 0, -500 0, -500 -900))"))
    for tool, refs in (
        (areas.GeneralizeLandcover(area_threshold=100), {}), (areas.GeneralizeConservationAreas(area_threshold=100), {"water_areas": water}),
        (areas.GeneralizeWaterAreas(min_area=100, area_simplification_tolerance=1), {}), (areas.GeneralizeBuildings(building_class_column="cls"), {}),
        (areas.GeneralizeBuildingAreas(building_filter_column="cls", threshold_building_area_far=3000, threshold_building_area_near=2000), {}),
    ):
        out = tool.execute(Features(squares), refs).df
        rows = out.select("fid", g.is_empty("geom").alias("e"), g.geom_type("geom").alias("t"), F.exists(g.vertices("geom"), lambda p: F.isnan(p[2])).alias("flat")).collect()
        assert rows and len({r["fid"] for r in rows}) == len(rows), type(tool).__name__
        assert not any(r["e"] or r["flat"] for r in rows) and {r["t"] for r in rows} <= {"Polygon", "Point"}, (type(tool).__name__, rows)


def test_which_ends(spark):
    from mapsmith.functions import coordinates as co

    of = co.ExtendFrom.from_bools
    assert [of(extend_start=a, extend_end=b) for a, b in ((True, True), (True, False), (False, True), (False, False))] == [co.ExtendFrom.BOTH, co.ExtendFrom.START, co.ExtendFrom.END, co.ExtendFrom.NONE]
    line = g.vertices(w("LINESTRING (0 0, 3 4)"))
    sizes = [one(spark, F.size(co.extend(line, 5.0, where))) for where in co.ExtendFrom]
    assert sorted(sizes) == [3, 3, 4, 4] and one(spark, F.element_at(co.extend(line, 5.0, co.ExtendFrom.END), -1))[:2] == [6.0, 8.0]


def test_types_schemas_and_reports(spark, tmp_path):
    from mapsmith.operators import model
    from mapsmith.sources import geopackage as gp

    assert model.parse_type("MultiPolygon") == "MultiPolygon"
    with pytest.raises(ValueError):
        model.parse_type("Circle")
    df = table(spark, "POINT (0 0)", "POINT (1 1)")
    none = model.empty_like(df, {"n": "long", None: "string"})
    assert none.count() == 0 and dict(none.dtypes)["n"] == "bigint" and len(none.columns) == len(df.columns) + 1
    assert model.check_types(none, {"Polygon"}) and not model.check_types(df, {"Polygon"})
    gp.write_parquet(Features(df), str(tmp_path / "t"))
    back = gp.read_parquet(spark, str(tmp_path / "t"))
    assert sorted(wkts(back.plain())) == ["POINT (0 0)", "POINT (1 1)"]
    gp.difference_report(df.select("fid"), df.select("fid").limit(0), str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d/left_only")).count() == 2 and spark.read.parquet(str(tmp_path / "d/right_only")).count() == 0


def test_command_line_runs(spark, tmp_path):
    """From file to file."""
    from mapsmith import cli
    from mapsmith.sources import geopackage as gp

    src, out = str(tmp_path / "in.gpkg"), str(tmp_path / "out.gpkg")
    gp.write_layer(Features(table(spark, "POINT (0 0)", "POINT (1 0)", "POINT (90 90)", kind=["a", "b", "c"])), src, "stones")
    cli.run(["points", f"{src}@stones", f"{out}@few", "--cluster-distance", "5", "--unique-id-column", "fid"])
    rows = gp.read_layer(spark, out, "few", "fid").df.select("kind", "is_cluster", g.wkt("geom").alias("w")).collect()
    assert sorted((r["kind"], bool(r["is_cluster"]), r["w"]) for r in rows) == [("a", True, "POINT (0.5 0)"), ("c", False, "POINT (90 90)")]
