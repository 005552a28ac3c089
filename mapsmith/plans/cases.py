"""Algorithms on tables laid out so that SQL can say what must come out: every row stands on ground of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapsmith.algorithms import areas, lines
from mapsmith.functions import geometry as g
from mapsmith.operators.model import Features
from mapsmith.plans.registry import AREA, query, rounded
from mapsmith.plans.shapes import wkt_of
from mapsmith.plans.views import duck, features, spread, view

SHORT = ["fid", "geom", "_ord"]


def laid_out(spark, sf_dir: str, name: str, step: int) -> DataFrame:
    """A view with a: where a row's ground begins, w and h: its extent, if it has one."""
    g.install(spark)
    df = spread(view(spark, sf_dir, name)).withColumn("_ord", F.array(F.col("k").cast("long"))).withColumn("a", F.col("k") * step)
    return df.withColumns({"w": F.expr("x1 - x0"), "h": F.expr("y1 - y0")}) if "x0" in df.columns else df


def at(df: DataFrame, pattern: str, *more: str, suffix: str = "", first: int = 0) -> DataFrame:
    """The rows with geometries from a pattern; ``suffix`` and ``first`` keep ids and orders of several such apart."""
    out = df.withColumn("geom", wkt_of(pattern)).withColumn("fid", F.concat("fid", F.lit(suffix))).withColumn("_ord", F.concat(F.array(F.lit(first).cast("long")), "_ord"))
    return out.select(*SHORT, *more)


@query("A3_buildings_apart", f"""WITH {duck("rects")}, s AS (SELECT fid, 3 * (x1 - x0) w, 3 * (y1 - y0) h FROM rects), t AS (SELECT fid, w, h, greatest(w, h) > 30 large, CASE WHEN least(w, h) <= 6 THEN (w + 6) * (h + 6) ELSE w * h END grown FROM s)
SELECT CASE WHEN large AND least(w, h) <= 6 THEN sha256('buildings' || fid || fid) ELSE fid END fid, CASE WHEN large THEN 'Polygon' ELSE 'Point' END kind, CAST(CASE WHEN large THEN grown ELSE 0 END AS DOUBLE) area FROM t WHERE NOT large OR grown >= 225""")
def buildings(spark, sf_dir):
    """Long buildings stay areas (narrow ones widened, by a part with the same id), the others become points; too small areas go."""
    df = at(laid_out(spark, sf_dir, "rects", 1000), "POLYGON (({a} 0, {a + 3 * w} 0, {a + 3 * w} {3 * h}, {a} {3 * h}, {a} 0))", "cls")
    out = areas.GeneralizeBuildings(building_class_column="cls").execute(Features(df)).df
    return out.select("fid", g.geom_type("geom").alias("kind"), F.round(g.area("geom"), 3).alias("area"))


@query("A6_contours_in_two", f"WITH {duck('masks')} SELECT fid_, k, CAST(k % 10 AS DOUBLE) z, 50.0 n, 12 vertices FROM masks, (VALUES (0), (1)) p(fid_) WHERE k % 5 = 0")
def contours(spark, sf_dir):
    """Straight contours cut at a slope mark: every fifth level stays, both pieces, with a curve (straight here) at
    the joint and the level as z."""
    m = laid_out(spark, sf_dir, "masks", 50)
    df = at(m, "LINESTRING (0 {a}, 100 {a})", "k").withColumn("elevation_value", F.col("k") % 10)
    out = lines.GeneralizeContours(gaussian_filter_strength=0.0, length_threshold=80.0).execute(Features(df), {"slope": Features(at(m, "POINT (50 {a})"))}).df
    v = g.vertices("geom")
    left = (F.least(v[0][0], F.element_at(v, -1)[0]) < 25).cast("int")
    return out.select((1 - left).alias("fid_"), "k", v[0][2].alias("z"), rounded(g.length("geom")).alias("n"), F.size(v).alias("vertices"))


@query("A7_two_yards", f"WITH {duck('masks')} SELECT k, CASE WHEN k % 2 = 0 THEN 2 ELSE 3 END lines, CASE WHEN k % 2 = 0 THEN 400.0 ELSE 600.0 END n FROM masks")
def yards(spark, sf_dir):
    """Two yards tied by a fence, a mast in the first of every second pair: only that yard is small for one with a
    mast, and its fence goes."""
    m = laid_out(spark, sf_dir, "masks", 2000)
    one = at(m, "LINESTRING ({a + 50} 0, {a + 50} 50, {a} 50, {a} 0, {a + 50} 0)", "k")
    tie = at(m, "LINESTRING ({a + 50} 0, {a + 250} 0)", "k", suffix="-t", first=1)
    two = at(m, "LINESTRING ({a + 250} 0, {a + 300} 0, {a + 300} 50, {a + 250} 50, {a + 250} 0)", "k", suffix="-2", first=2)
    masts = at(m.where("k % 2 = 0"), "POINT ({a + 20} 20)")
    out = lines.GeneralizeFences(attribute_for_line_merge="k").execute(Features(one.unionByName(tie).unionByName(two)), {"masts": Features(masts)}).df
    return out.groupBy("k").agg(F.count("*").cast("int").alias("lines"), rounded(F.sum(g.length("geom"))).alias("n"))


@query("A9_landcover_squared", f"""WITH {duck("masks")}, d AS MATERIALIZED (SELECT DISTINCT cx, unnest(range(y0 - 4, y1 + 4)) cy FROM (SELECT unnest(range(x0 - 4, x1 + 4)) cx, y0, y1 FROM masks)),
r AS MATERIALIZED (SELECT cx, cy, count(*) OVER (PARTITION BY cx ORDER BY cy RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 whole FROM d),
e AS MATERIALIZED (SELECT cx, cy, count(*) OVER (PARTITION BY cy ORDER BY cx RANGE BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 whole FROM r WHERE whole),
f AS (SELECT DISTINCT cx, unnest(range(cy - 2, cy + 3)) cy FROM (SELECT unnest(range(cx - 2, cx + 3)) cx, cy FROM e WHERE whole)) SELECT CAST(count(*) AS DOUBLE) area FROM f""")
def landcover(spark, sf_dir):
    """Grown by 4, shrunk by 6, grown by 2, all with square corners, in unit cells."""
    df = Features(features(spark, sf_dir, "masks").select(*SHORT))
    tool = areas.GeneralizeLandcover(positive_buffer=4, negative_buffer=-2, simplification_tolerance=0, area_threshold=0, hole_threshold=0, buffer_join_style="mitre")
    return tool.execute(df).df.agg(rounded(F.sum(g.area("geom"))).alias("area"))


@query("A11_parallel_lines", f"WITH {duck('masks')} SELECT k, 1 lines, true long, k % 2 = 0 tied FROM masks")
def power_lines(spark, sf_dir):
    """Two lines side by side become one about as long; it reaches the fence at its end, where there is one."""
    m = laid_out(spark, sf_dir, "masks", 2000)
    one = at(m, "LINESTRING ({a} 0, {a + 400} 0)", "k")
    two = at(m, "LINESTRING ({a + 400} 10, {a} 10)", "k", suffix="-2", first=1)
    fences = at(m.where("k % 2 = 0"), "LINESTRING ({a + 400} -50, {a + 400} 60)")
    none = at(m.limit(0), "POLYGON (({a} 0, {a + 1} 0, {a + 1} 1, {a} 0))")
    df = one.unionByName(two).withColumn("function", F.lit("pair"))
    out = lines.GeneralizePowerLines(classes_for_merge_parallel_lines=frozenset({"pair"}), distance_threshold_for_parallel_lines=20).execute(Features(df), {"fences": Features(fences), "substations": Features(none)}).df
    east = g.call("envelope", "geom")[2] - F.col("k") * 2000
    return out.groupBy("k").agg(F.count("*").cast("int").alias("lines"), F.min(g.length("geom").between(370, 430)).alias("long"), (F.max(east) >= 399.999).alias("tied"))


@query("A16_lakes_and_islands", f"""WITH {duck("rects")}, l AS (SELECT fid, 20 * (x1 - x0) w, 20 * (y1 - y0) h, 10 + k % 5 i FROM rects WHERE 400 * {AREA} > 5000)
SELECT fid, 'Polygon' kind, CAST(w * h - CASE WHEN i >= 13 THEN 10 * i ELSE 0 END AS DOUBLE) area, CAST(2 * (w + h) + CASE WHEN i >= 13 THEN 2 * (i + 10) ELSE 0 END AS DOUBLE) n FROM l
UNION ALL SELECT fid || s, 'LineString', 0.0, CAST(w + h AS DOUBLE) FROM l, (VALUES ('-lower'), ('-upper')) t(s)
UNION ALL SELECT fid || '-island', 'LineString', 0.0, CAST(2 * (i + 10) AS DOUBLE) FROM l WHERE i >= 13""")
def lakes(spark, sf_dir):
    """Lakes with an island of (10 + k % 5) by 10: small lakes and islands go; the shore comes in the pieces that it
    had."""
    r = laid_out(spark, sf_dir, "rects", 3000).withColumns({"w": F.expr("20 * w"), "h": F.expr("20 * h"), "i": F.expr("10 + k % 5")})
    lake = at(r, "POLYGON (({a} 0, {a + w} 0, {a + w} {h}, {a} {h}, {a} 0), ({a + 5} 5, {a + 5 + i} 5, {a + 5 + i} 15, {a + 5} 15, {a + 5} 5))")
    lower = at(r, "LINESTRING ({a} 0, {a + w} 0, {a + w} {h})", suffix="-lower")
    upper = at(r, "LINESTRING ({a + w} {h}, {a} {h}, {a} 0)", suffix="-upper", first=1)
    island = at(r, "LINESTRING ({a + 5} 5, {a + 5 + i} 5, {a + 5 + i} 15, {a + 5} 15, {a + 5} 5)", suffix="-island", first=2)
    tool = areas.GeneralizeWaterAreas(min_area=5000, area_simplification_tolerance=1, island_simplification_tolerance=1, thin_section_exaggerate_by=0, island_min_area=120, island_min_elongation=0, smoothing_passes=0)
    out = tool.execute(Features(lake), {"shoreline": Features(lower.unionByName(upper).unionByName(island))}).df
    return out.select("fid", g.geom_type("geom").alias("kind"), F.round(g.area("geom"), 3).alias("area"), F.round(g.length("geom"), 3).alias("n"))


@query("A17_river_mouths", f"WITH {duck('masks')} SELECT k, CASE WHEN k % 2 = 0 THEN '1,2' ELSE '1' END types FROM masks")
def rivers(spark, sf_dir):
    """A lake with a river becomes an area and a line, a lake alone an area."""
    m = laid_out(spark, sf_dir, "masks", 800)
    lake = at(m.where("k % 2 = 1"), "POLYGON (({a} -100, {a + 200} -100, {a + 200} 100, {a} 100, {a} -100))", "k")
    both = at(m.where("k % 2 = 0"), "POLYGON (({a} -100, {a + 200} -100, {a + 200} -5, {a + 500} -5, {a + 500} 5, {a + 200} 5, {a + 200} 100, {a} 100, {a} -100))", "k")
    out = areas.GeneralizeWaterCourseAreas(area_simplification_tolerance=1, min_new_section_length=100).execute(Features(lake.unionByName(both))).df
    return out.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("feature_type")), ",").alias("types"))
