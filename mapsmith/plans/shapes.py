"""Queries on single shapes: filters on odd geometries, parts, holes, segments, edits of lines and outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapsmith.functions import coordinates as co
from mapsmith.functions import geometry as g
from mapsmith.operators import features as fe
from mapsmith.operators import spatial as sp
from mapsmith.operators.model import wrong_types
from mapsmith.plans.registry import AREA, query, rounded
from mapsmith.plans.views import duck, features, view


def wkt_of(pattern: str) -> Column:
    """``pattern`` with {column} (or {sql expression}) filled in, as a geometry."""
    out, rest = [], pattern
    while "{" in rest:
        before, _, rest = rest.partition("{")
        inner, _, rest = rest.partition("}")
        out += [F.lit(before), F.expr(inner).cast("string")]
    return g.from_wkt(F.concat(*out, F.lit(rest)))


def shaped(spark, sf_dir: str, name: str, pattern: str) -> DataFrame:
    """A view with geometries from a pattern."""
    g.install(spark)
    return view(spark, sf_dir, name).withColumn("_ord", F.array(F.col("k").cast("long"))).withColumn("geom", wkt_of(pattern))


#: The rectangles ten times as large, with a hole of (k % 5 + 1) by (k % 4 + 1) one unit from the corner.
HOLED = "POLYGON (({x0 * 10} {y0 * 10}, {x1 * 10} {y0 * 10}, {x1 * 10} {y1 * 10}, {x0 * 10} {y1 * 10}, {x0 * 10} {y0 * 10}), ({x0 * 10 + 1} {y0 * 10 + 1}, {x0 * 10 + 2 + k % 5} {y0 * 10 + 1}, {x0 * 10 + 2 + k % 5} {y0 * 10 + 2 + k % 4}, {x0 * 10 + 1} {y0 * 10 + 2 + k % 4}, {x0 * 10 + 1} {y0 * 10 + 1}))"
HOLE = "(k % 5 + 1) * (k % 4 + 1)"


# filters ----------------------------------------------------------------------------------------------------------


@query("F1_wrong_types", f"WITH {duck('rects', 'pts', 'masks')} SELECT 'p' || fid fid FROM pts UNION ALL SELECT 'm' || fid FROM masks WHERE k % 2 = 0")
def wrong(spark, sf_dir):
    r, p, m = (features(spark, sf_dir, n).select("fid", "k", "geom") for n in ("rects", "pts", "masks"))
    m = m.withColumn("geom", F.when(F.col("k") % 2 == 1, F.col("geom")))  # null is a wrong type
    every = r.unionByName(p.withColumn("fid", F.concat(F.lit("p"), "fid"))).unionByName(m.withColumn("fid", F.concat(F.lit("m"), "fid")))
    return wrong_types(every, {"Polygon"}).select("fid")


@query("F6_drop_empty", f"WITH {duck('rects')} SELECT fid, CAST({AREA} AS DOUBLE) area FROM rects WHERE k % 5 != 0 AND k % 7 != 0")
def no_empties(spark, sf_dir):
    r = features(spark, sf_dir, "rects")
    odd = r.withColumn("geom", F.when(F.col("k") % 5 == 0, g.from_wkt(F.lit("POLYGON EMPTY"))).when(F.col("k") % 7 != 0, F.col("geom")))
    return fe.drop_empty(odd).select("fid", g.area("geom").alias("area"))


@query("F7_fix_invalid", f"WITH {duck('rects')} SELECT fid, CASE WHEN k % 3 = 0 THEN {AREA} / 2.0 ELSE CAST({AREA} AS DOUBLE) END area, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END parts FROM rects")
def fixed(spark, sf_dir):
    """Every third outline crosses itself, into two triangles."""
    r = features(spark, sf_dir, "rects")
    bow = wkt_of("POLYGON (({x0} {y0}, {x1} {y1}, {x1} {y0}, {x0} {y1}, {x0} {y0}))")
    out = fe.fix_invalid(r.withColumn("geom", F.when(F.col("k") % 3 == 0, bow).otherwise(F.col("geom"))))
    return out.select("fid", rounded(g.area("geom")).alias("area"), F.size(g.dump("geom")).alias("parts"))


@query("F8_remove_small_holes", f"WITH {duck('rects')} SELECT fid, CAST(100 * {AREA} - CASE WHEN {HOLE} > 6 THEN {HOLE} ELSE 0 END AS DOUBLE) area FROM rects")
def fewer_holes(spark, sf_dir):
    return fe.remove_small_holes(shaped(spark, sf_dir, "rects", HOLED), 6).select("fid", g.area("geom").alias("area"))


@query("F14_split_by_ratio", f"WITH {duck('rects')} SELECT fid, coalesce({AREA} / nullif(CAST((k % 4) * 300 AS DOUBLE), 0) > 0.5, false) coastal FROM rects")
def by_ratio(spark, sf_dir):
    r = features(spark, sf_dir, "rects").withColumn("ratio", F.try_divide(g.area("geom"), ((F.col("k") % 4) * 300).cast("double")))
    above, rest = fe.split_by_ratio(r, "ratio")
    return above.select("fid", F.lit(True).alias("coastal")).unionByName(rest.select("fid", F.lit(False).alias("coastal")))


# parts, holes, segments -------------------------------------------------------------------------------------------

PARTS = "MULTIPOLYGON ((({x0} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0})), (({x0 + 2000} {y0}, {x0 + 2000 + 1 + k % 30} {y0}, {x0 + 2000 + 1 + k % 30} {y0 + 10}, {x0 + 2000} {y0 + 10}, {x0 + 2000} {y0})))"


@query("S1_parts", f"WITH {duck('rects')} SELECT fid, 0 part, CAST({AREA} AS DOUBLE) area FROM rects UNION ALL SELECT fid, 1, CAST(10 * (1 + k % 30) AS DOUBLE) FROM rects")
def parts(spark, sf_dir):
    r = shaped(spark, sf_dir, "rects", PARTS).select("fid", F.posexplode(g.dump("geom")).alias("part", "geom"))
    return r.select("fid", "part", g.area("geom").alias("area"))


@query("S2_over_parts", f"WITH {duck('rects')} SELECT fid, 2 parts, round(({AREA} + 10 * (1 + k % 30)) * 0.875, 6) area FROM rects")
def over_parts(spark, sf_dir):
    """A shape function (corner cutting) goes over the parts of a multipart shape."""
    r = shaped(spark, sf_dir, "rects", PARTS).withColumn("geom", g.call("smooth", "geom", F.array().cast("array<binary>"), F.lit(1)))
    return r.select("fid", F.size(g.dump("geom")).alias("parts"), rounded(g.area("geom")).alias("area"))


@query("S21_largest_part", f"WITH {duck('rects')} SELECT fid, CAST(greatest({AREA}, 10 * (1 + k % 30)) AS DOUBLE) area FROM rects")
def largest(spark, sf_dir):
    return fe.largest_part(shaped(spark, sf_dir, "rects", PARTS)).select("fid", g.area("geom").alias("area"))


@query("W5_longest_part", f"WITH {duck('rects')} SELECT fid, CAST(greatest(x1 - x0, y1 - y0) AS DOUBLE) n FROM rects")
def longest(spark, sf_dir):
    r = shaped(spark, sf_dir, "rects", "MULTILINESTRING (({x0} {y0}, {x1} {y0}), ({x0 + 2000} {y0}, {x0 + 2000} {y1}))")
    return fe.largest_part(r).select("fid", g.length("geom").alias("n"))


@query("S22_small_parts", f"WITH {duck('rects')} SELECT fid, CAST(CASE WHEN {AREA} > 150 THEN {AREA} ELSE 0 END + CASE WHEN 10 * (1 + k % 30) > 150 THEN 10 * (1 + k % 30) ELSE 0 END AS DOUBLE) area, {AREA} <= 150 AND 10 * (1 + k % 30) <= 150 none FROM rects")
def not_small(spark, sf_dir):
    out = fe.remove_small_parts(shaped(spark, sf_dir, "rects", PARTS), 150.0)
    return out.select("fid", g.area("geom").alias("area"), g.is_empty("geom").alias("none"))


@query("S7_S8_interior_rings", f"WITH {duck('rects')} SELECT fid, CAST({HOLE} AS DOUBLE) area FROM rects WHERE k % 3 != 0")
def holes(spark, sf_dir):
    r = features(spark, sf_dir, "rects").withColumn("geom", F.when(F.col("k") % 3 == 0, F.col("geom")).otherwise(wkt_of(HOLED)))
    return fe.interior_rings(r).select("fid", g.area("geom").alias("area"))


@query("S38_remove_holes", f"WITH {duck('rects')} SELECT fid, CAST(100 * {AREA} AS DOUBLE) area FROM rects")
def no_holes(spark, sf_dir):
    out = fe.remove_small_holes(shaped(spark, sf_dir, "rects", HOLED), 20.0)
    return out.select("fid", g.area("geom").alias("area"))


@query("S30_rings", f"WITH {duck('rects')} SELECT fid, 2 rings, CAST(20 * (x1 - x0 + y1 - y0) + 2 * (k % 5 + 1 + k % 4 + 1) AS DOUBLE) n FROM rects")
def rings(spark, sf_dir):
    r = shaped(spark, sf_dir, "rects", HOLED).withColumn("geom", g.boundary("geom"))
    return r.select("fid", F.size(g.dump("geom")).alias("rings"), g.length("geom").alias("n"))


@query("S12_S13_segments", f"WITH {duck('rects')} SELECT fid, i seg, CAST(CASE WHEN i % 2 = 0 THEN x1 - x0 ELSE y1 - y0 END AS DOUBLE) n FROM rects, range(4) t(i)")
def segments(spark, sf_dir):
    rims = features(spark, sf_dir, "rects").withColumn("geom", g.boundary("geom"))
    seg = rims.select("fid", F.posexplode(co.segments(g.vertices("geom"))).alias("seg", "s"))
    return seg.select("fid", F.col("seg").cast("long").alias("seg"), g.length(g.line(F.array("s.a", "s.b"))).alias("n"))


@query("S42_main_angle", f"WITH {duck('rects')} SELECT fid, CASE WHEN x1 - x0 > y1 - y0 THEN 90.0 ELSE 0.0 END angle FROM rects WHERE x1 - x0 != y1 - y0")
def angle(spark, sf_dir):
    return features(spark, sf_dir, "rects").where("x1 - x0 != y1 - y0").select("fid", rounded(fe.main_angle()).alias("angle"))


@query("S43_buffer", f"WITH {duck('rects')} SELECT fid, CAST((x1 - x0 + 6) * (y1 - y0 + 6) AS DOUBLE) mitre, round({AREA} + 6 * (x1 - x0 + y1 - y0) + 18, 6) bevel, round({AREA} + 6 * (x1 - x0 + y1 - y0) + 288 * sin(pi() / 32), 6) round_, CAST(greatest(x1 - x0 - 6, 0) * greatest(y1 - y0 - 6, 0) AS DOUBLE) inner_ FROM rects")
def buffers(spark, sf_dir):
    """Sixteen pieces to a quarter circle."""
    of = lambda d, j: rounded(g.area(g.buffer("geom", d, join=j)))
    return features(spark, sf_dir, "rects").select("fid", of(3, "mitre").alias("mitre"), of(3, "bevel").alias("bevel"), of(3, "round").alias("round_"), of(-3, "mitre").alias("inner_"))


# lines ------------------------------------------------------------------------------------------------------------

#: From a point 10 to the right, 20 up and 10 to the right, with z.
STAIRS = "LINESTRING Z ({x} {y} 1, {x + 10} {y} 3, {x + 10} {y + 20} 5, {x + 20} {y + 20} 7)"


@query("S9_S20_z", f"WITH {duck('pts')} SELECT fid, 4.0 mean, CAST(k % 11 AS DOUBLE) set_ FROM pts")
def heights(spark, sf_dir):
    p = shaped(spark, sf_dir, "pts", STAIRS).withColumn("level", (F.col("k") % 11).cast("double"))
    own = fe.z_from_attribute(p, "level")
    return p.join(own.select("fid", F.col("geom").alias("_g")), "fid").select("fid", co.mean_z(g.vertices("geom")).alias("mean"), co.mean_z(g.vertices("_g")).alias("set_"))


@query("S15_move_to", f"WITH {duck('pts')} SELECT fid, CAST(y AS DOUBLE) x, CAST(x AS DOUBLE) y, CAST(y - 15 AS DOUBLE) ax FROM pts")
def moved(spark, sf_dir):
    """A polygon or line is moved by its centroid."""
    p = shaped(spark, sf_dir, "pts", "POLYGON (({x} {y}, {x + 30} {y}, {x + 30} {y + 10}, {x} {y + 10}, {x} {y}))")
    out = p.withColumn("geom", fe.moved_to("geom", F.col("y").cast("double"), F.col("x").cast("double")))
    c, v = F.element_at(g.vertices(g.centroid("geom")), 1), g.call("envelope", "geom")
    return out.select("fid", rounded(c[0]).alias("x"), rounded(c[1]).alias("y"), rounded(v[0]).alias("ax"))


@query("S18_point_on_line", f"WITH {duck('pts')} SELECT fid, round(x + 3 + 0.6 * 5, 6) beyond, round(x - 0.6 * 5, 6) before_, CAST(x + 3 AS DOUBLE) end_ FROM pts")
def beyond(spark, sf_dir):
    p = view(spark, sf_dir, "pts")
    a, b = (F.array(*(F.expr(c).cast("double") for c in (x, y, "0"))) for x, y in (("x", "y"), ("x + 3", "y + 4")))
    of = lambda d: rounded(co.point_on_line(a, b, F.lit(d))[0])
    return p.select("fid", of(5.0).alias("beyond"), of(-5.0).alias("before_"), of(0.0).alias("end_"))


@query("S28_angle_difference", f"WITH {duck('pts')} SELECT fid, CAST(abs((((x % 360) - (y % 360) + 180) % 360 + 360) % 360 - 180) AS DOUBLE) d FROM pts")
def angles(spark, sf_dir):
    return view(spark, sf_dir, "pts").select("fid", co.angle_difference((F.col("x") % 360).cast("double"), (F.col("y") % 360).cast("double")).alias("d"))


@query("S31_split", f"WITH {duck('rects')} SELECT fid, CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END pieces, CAST(2 * (x1 - x0 + y1 - y0) AS DOUBLE) n, CASE WHEN k % 2 = 0 THEN (x1 - x0) + (y1 - y0) ELSE 2.0 * (x1 - x0 + y1 - y0) END shortest FROM rects")
def split(spark, sf_dir):
    """Rings cut by a line through two opposite sides come in two pieces; those that are met once stay whole."""
    r = features(spark, sf_dir, "rects").withColumn("geom", g.boundary("geom"))
    across = F.when(F.col("k") % 2 == 0, wkt_of("LINESTRING ({(x0 + x1) / 2.0D} {y0 - 1}, {(x0 + x1) / 2.0D} {y1 + 1})")).otherwise(wkt_of("POINT ({x1} {y1})"))
    pieces = r.select("fid", F.explode(g.call("split", "geom", across)).alias("p"))
    return pieces.groupBy("fid").agg(F.count("*").cast("int").alias("pieces"), rounded(F.sum(g.length("p"))).alias("n"), rounded(F.min(g.length("p"))).alias("shortest"))


@query("S31_split_line", f"WITH {duck('pts')} SELECT fid, 3 pieces, 40.0 n, 5.0 shortest FROM pts")
def split_line(spark, sf_dir):
    p = shaped(spark, sf_dir, "pts", STAIRS)
    by = wkt_of("MULTIPOINT (({x + 5} {y}), ({x + 10} {y + 20}), ({x} {y}), ({x + 500} {y}))")
    pieces = p.select("fid", F.explode(g.call("split", "geom", by)).alias("p"))
    return pieces.groupBy("fid").agg(F.count("*").cast("int").alias("pieces"), rounded(F.sum(g.length("p"))).alias("n"), rounded(F.min(g.length("p"))).alias("shortest"))


@query("S32_simplify_keep", f"WITH {duck('pts')} SELECT fid, CASE WHEN k % 2 = 0 THEN 4 ELSE 3 END n FROM pts")
def simplified(spark, sf_dir):
    """The flat vertex goes unless it is kept, the high one stays."""
    p = shaped(spark, sf_dir, "pts", "LINESTRING ({x} {y}, {x + 10} {y + 1}, {x + 20} {y}, {x + 30} {y + 30})")
    keep = F.when(F.col("k") % 2 == 0, F.array(wkt_of("POINT ({x + 10} {y + 1})"))).otherwise(F.array().cast("array<binary>"))
    return p.select("fid", F.size(g.vertices(g.call("simplifykeep", "geom", keep, F.lit(3.0)))).alias("n"))


@query("S34_topological_points", f"WITH {duck('pts')} SELECT fid, 4 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END n, CASE WHEN k % 3 = 0 THEN 2.0 END z FROM pts")
def inserted(spark, sf_dir):
    """A point on a segment becomes a vertex, with a z between; one that is a vertex, or off the line, does not."""
    p = shaped(spark, sf_dir, "pts", STAIRS)
    at = F.when(F.col("k") % 3 == 0, wkt_of("POINT ({x + 5} {y})")).when(F.col("k") % 3 == 1, wkt_of("POINT ({x + 10} {y})")).otherwise(wkt_of("POINT ({x + 5} {y + 1})"))
    v = g.vertices(g.call("addpoints", "geom", F.array(at), F.lit(0.0)))
    return p.select("fid", F.size(v).alias("n"), F.when(F.col("k") % 3 == 0, v[1][2]).alias("z"))


@query("S35_snap", f"WITH {duck('pts')} SELECT fid, CAST(x + 5 AS DOUBLE) x, CAST(CASE WHEN k % 9 <= 6 THEN y ELSE y - k % 9 END AS DOUBLE) y, CASE WHEN k % 9 <= 6 THEN 9.0 ELSE 9.0 END z FROM pts")
def snapped(spark, sf_dir):
    """Points below a segment move onto it, up to a tolerance, and keep their z."""
    p = shaped(spark, sf_dir, "pts", STAIRS)
    v = F.element_at(g.vertices(g.call("snap", wkt_of("POINT Z ({x + 5} {y - k % 9} 9)"), "geom", F.lit(6.0), F.lit(True))), 1)
    return p.select("fid", rounded(v[0]).alias("x"), rounded(v[1]).alias("y"), rounded(v[2]).alias("z"))


@query("S37_split_at_distances", f"WITH {duck('pts')} SELECT fid, i piece, CASE i WHEN 0 THEN 10.0 WHEN 1 THEN 5.0 WHEN 2 THEN 15.0 ELSE 10.0 END n FROM pts, range(4) t(i)")
def at_distances(spark, sf_dir):
    """Cuts on vertices and between them; 0 and the whole length are no cuts."""
    p = shaped(spark, sf_dir, "pts", STAIRS)
    return p.select("fid", F.posexplode(fe.split_at("geom", [0.0, 30.0, 10.0, 15.0, 40.0, 15.0])).alias("piece", "g")).select("fid", F.col("piece").cast("long").alias("piece"), rounded(g.length("g")).alias("n"))


@query("S16_extend_to_nearest", f"WITH {duck('pts')} SELECT fid, CASE WHEN k % 10 = 0 THEN 40.0 ELSE 40.0 + CASE WHEN k % 10 <= 6 THEN k % 10 ELSE 0 END END n FROM pts")
def extended(spark, sf_dir):
    """The end is led on to a wall k % 10 to the right, if that is no more than 6 away."""
    from mapsmith.operators.network import extend_to

    p = shaped(spark, sf_dir, "pts", STAIRS.replace(" Z", "").replace(" 1,", ",").replace(" 3,", ",").replace(" 5,", ",").replace(" 7)", ")")).withColumn("wall", wkt_of("LINESTRING ({x + 20 + k % 10} {y - 50}, {x + 20 + k % 10} {y + 50})"))
    return p.select("fid", rounded(g.length(extend_to("geom", "wall", F.lit(False), F.lit(True), 6.0))).alias("n"))


@query("S39_smooth_joint", f"WITH {duck('pts')} SELECT fid, 12 n1, 12 n2, CAST(x + 100 AS DOUBLE) jx, CAST(y AS DOUBLE) jy, CAST(x + 70 AS DOUBLE) cut FROM pts")
def joint(spark, sf_dir):
    """Two lines that meet at a right angle: each keeps its far end, and gets ten new vertices from the cut to the
    joint, which the curve goes through."""
    p = view(spark, sf_dir, "pts")
    g.install(spark)
    lines = F.array(wkt_of("LINESTRING ({x} {y}, {x + 100} {y})"), wkt_of("LINESTRING ({x + 100} {y}, {x + 100} {y + 100})"))
    out = p.withColumn("s", g.call("smoothjoints", lines, F.array(wkt_of("POINT ({x + 100} {y})")), F.lit(30.0), F.lit(10)))
    a, b = g.vertices(F.col("s")[0]), g.vertices(F.col("s")[1])
    end = F.element_at(a, -1)
    return out.select("fid", F.size(a).alias("n1"), F.size(b).alias("n2"), rounded(end[0]).alias("jx"), rounded(end[1]).alias("jy"), rounded(a[1][0]).alias("cut"))


@query("S24_narrow_places", f"WITH {duck('pts')} SELECT fid, CAST(20 + k % 7 AS DOUBLE) n FROM pts")
def narrow(spark, sf_dir):
    """A corridor of width 4 behind a hall of width 40: what is left of the middle line is in the corridor."""
    p = shaped(spark, sf_dir, "pts", "POLYGON (({x} {y - 20}, {x + 40} {y - 20}, {x + 40} {y - 2}, {x + 60 + k % 7} {y - 2}, {x + 60 + k % 7} {y + 2}, {x + 40} {y + 2}, {x + 40} {y + 20}, {x} {y + 20}, {x} {y - 20}))")
    middle = wkt_of("LINESTRING ({x + 5} {y}, {x + 20} {y}, {x + 40} {y}, {x + 50} {y}, {x + 60 + k % 7} {y})")
    return p.select("fid", rounded(g.length(g.call("narrowplaces", middle, "geom", F.lit(10.0)))).alias("n"))


@query("S23_centre_line_length", f"WITH {duck('rects')} SELECT fid, true inside, true long FROM rects WHERE x1 - x0 >= 3 * (y1 - y0)")
def centre_lines(spark, sf_dir):
    """Of a long rectangle: about its length (from one end's corner, or fork, to the other's), all of it inside."""
    r = features(spark, sf_dir, "rects").where("x1 - x0 >= 3 * (y1 - y0)").withColumn("_c", g.with_double("center", "geom", 1.0))
    n, w, h = g.call("centrelength", "geom", F.lit(True), F.lit(1.0)), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return r.select("fid", g.call("covers", g.buffer("geom", 1e-6), "_c").alias("inside"), ((n >= w - 1.5 * h) & (n <= w + 2 * h)).alias("long"))


@query("K3_squared", f"WITH {duck('rects')} SELECT fid, 4 corners, CAST({AREA} * 400 AS DOUBLE) area FROM rects")
def squared(spark, sf_dir):
    """Rectangles, 20 times as large, with a bay of 3 by 3 in the lower side and a bump of 3 by 2 on the upper one:
    walls shorter than 5 go and the rectangle is left."""
    r = shaped(
        spark, sf_dir, "rects",
        "POLYGON (({x0 * 20} {y0 * 20}, {x0 * 20 + 8} {y0 * 20}, {x0 * 20 + 8} {y0 * 20 + 3}, {x0 * 20 + 11} {y0 * 20 + 3}, {x0 * 20 + 11} {y0 * 20}, {x1 * 20} {y0 * 20}, {x1 * 20} {y1 * 20}, {x1 * 20 - 6} {y1 * 20}, {x1 * 20 - 6} {y1 * 20 + 2}, {x1 * 20 - 9} {y1 * 20 + 2}, {x1 * 20 - 9} {y1 * 20}, {x0 * 20} {y1 * 20}, {x0 * 20} {y0 * 20}))",
    )
    out = r.withColumn("geom", g.with_double("squared", "geom", 5.0))
    return out.select("fid", F.size(g.vertices("geom")).alias("corners"), rounded(g.area("geom")).alias("area"))


@query("K1_keep_vertices", f"WITH {duck('pts')} SELECT fid, CASE WHEN k % 2 = 0 THEN 5 ELSE 4 END n FROM pts")
def thinned(spark, sf_dir):
    """The vertex of a small triangle goes from an outline unless it is protected."""
    p = shaped(spark, sf_dir, "pts", "POLYGON (({x} {y}, {x + 50} {y + 1}, {x + 100} {y}, {x + 100} {y + 100}, {x} {y + 100}, {x} {y}))")
    keep = F.when(F.col("k") % 2 == 0, F.array(wkt_of("POINT ({x + 50} {y + 1})"))).otherwise(F.array().cast("array<binary>"))
    return p.select("fid", F.size(g.vertices(g.call("thin", "geom", keep, F.lit(10.0)))).alias("n"))


@query("K5_gaussian", f"WITH {duck('pts')} SELECT fid, CAST(x AS DOUBLE) ax, CAST(x + 200 AS DOUBLE) bx, true shorter, true near FROM pts")
def gaussian(spark, sf_dir):
    """Ends stay, a zigzag gets shorter and keeps near its middle line."""
    p = shaped(spark, sf_dir, "pts", "LINESTRING ({x} {y}, {x + 50} {y + 5}, {x + 100} {y - 5}, {x + 150} {y + 5}, {x + 200} {y})")
    out = p.withColumn("s", g.with_double("gauss", "geom", 20.0))
    e = g.call("envelope", "s")
    return out.select("fid", rounded(g.start_of("s")[0]).alias("ax"), rounded(g.end_of("s")[0]).alias("bx"), (g.length("s") < g.length("geom")).alias("shorter"), (F.greatest(F.abs(e[1] - F.col("y")), F.abs(e[3] - F.col("y"))) < 5).alias("near"))


@query("K7_simplify_topology", f"WITH {duck('rects')} SELECT fid, CAST({AREA} AS DOUBLE) area, 4 n FROM rects")
def topology(spark, sf_dir):
    """A vertex in the middle of a side goes; the corners stay."""
    r = shaped(spark, sf_dir, "rects", "POLYGON (({x0} {y0}, {(x0 + x1) / 2.0D} {y0}, {x1} {y0}, {x1} {y1}, {x0} {y1}, {x0} {y0}))").withColumn("geom", g.with_double("simplifytopology", "geom", 0.1))
    return r.select("fid", g.area("geom").alias("area"), F.size(g.vertices("geom")).alias("n"))


# rows as tables ---------------------------------------------------------------------------------------------------


@query("P4_polygons_to_points", f"WITH {duck('rects')} SELECT fid, {AREA} >= 150 kept, true inside, CASE WHEN {AREA} < 150 THEN 4.0 END z FROM rects")
def to_points(spark, sf_dir):
    r = shaped(spark, sf_dir, "rects", "POLYGON Z (({x0} {y0} 1, {x1} {y0} 3, {x1} {y1} 5, {x0} {y1} 7, {x0} {y0} 1))")
    out = fe.polygons_to_points(r, 150).join(r.select("fid", F.col("geom").alias("_old")), "fid")
    return out.select("fid", (g.geom_type("geom") == "Polygon").alias("kept"), g.call("intersects", "geom", "_old").alias("inside"), F.when(g.geom_type("geom") == "Point", F.element_at(g.vertices("geom"), 1)[2]).alias("z"))


@query("P6_exaggerate_thin", f"WITH {duck('rects')} SELECT fid, CAST(CASE WHEN least(x1 - x0, y1 - y0) <= 8 AND least(x1 - x0, y1 - y0) / greatest(x1 - x0, y1 - y0) <= 0.5 THEN (x1 - x0 + 4) * (y1 - y0 + 4) ELSE {AREA} END AS DOUBLE) area FROM rects")
def exaggerated(spark, sf_dir):
    return fe.exaggerate_thin(features(spark, sf_dir, "rects"), 8, 0.5, 2, join="mitre").select("fid", rounded(g.area("geom")).alias("area"))


@query("P5_narrow_parts", f"WITH {duck('pts')} SELECT fid, CASE WHEN k % 3 = 0 THEN 0.0 ELSE CAST(4 * (20 + k % 7) AS DOUBLE) END area FROM pts WHERE k <= 150")
def narrow_parts(spark, sf_dir):
    """A hall with a corridor of width 4 (every third has none), each on ground of its own: the corridor is what an
    opening by 10 takes away; a row for each."""
    p = shaped(spark, sf_dir, "pts", "POINT ({x} {y})").where("k <= 150").withColumn("a", F.col("k") * 200)
    hall = wkt_of("POLYGON (({a} -20, {a + 40} -20, {a + 40} 20, {a} 20, {a} -20))")
    both = wkt_of("POLYGON (({a} -20, {a + 40} -20, {a + 40} -2, {a + 60 + k % 7} -2, {a + 60 + k % 7} 2, {a + 40} 2, {a + 40} 20, {a} 20, {a} -20))")
    out = fe.narrow_parts(p.withColumn("geom", F.when(F.col("k") % 3 == 0, hall).otherwise(both)), 10)
    return out.select("fid", rounded(g.area("geom")).alias("area"))


@query("S6_perforate", f"WITH {duck('rects')} SELECT fid, CAST(900 * {AREA} - CASE WHEN k % 2 = 0 THEN 100 ELSE 0 END AS DOUBLE) area FROM rects WHERE k <= 60")
def perforated(spark, sf_dir):
    """Polygons (set apart from each other) without the outlines of lakes within them; a lake that sticks out, and the
    hole of a lake, do not count."""
    r = view(spark, sf_dir, "rects").where("k <= 60").withColumn("_ord", F.array(F.col("k").cast("long"))).withColumn("a", F.col("k") * 2000)
    g.install(spark)
    ground = r.withColumn("geom", wkt_of("POLYGON (({a} 0, {a + 30 * (x1 - x0)} 0, {a + 30 * (x1 - x0)} {30 * (y1 - y0)}, {a} {30 * (y1 - y0)}, {a} 0))"))
    inner = wkt_of("POLYGON (({a + 5} 5, {a + 15} 5, {a + 15} 15, {a + 5} 15, {a + 5} 5), ({a + 7} 7, {a + 8} 7, {a + 8} 8, {a + 7} 8, {a + 7} 7))")
    across = wkt_of("POLYGON (({a - 5} 5, {a + 5} 5, {a + 5} 15, {a - 5} 15, {a - 5} 5))")
    lakes = r.withColumn("geom", F.when(F.col("k") % 2 == 0, inner).otherwise(across))
    return sp.perforate(ground, lakes).select("fid", rounded(g.area("geom")).alias("area"))
