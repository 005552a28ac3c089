"""Named queries over the driver's tables, each with the SQL that says the same where SQL can.

A query's name starts with the inventory's id of what it applies. Results are scalars (ids, counts, rounded
measures), as two engines may order the vertices of one geometry differently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapsmith.algorithms import ALGORITHMS, areas, lines
from mapsmith.functions import coordinates as co
from mapsmith.functions import geometry as g
from mapsmith.operators import features as fe
from mapsmith.operators import network as nw
from mapsmith.operators import points as pt
from mapsmith.operators import spatial as sp
from mapsmith.operators.model import Features
from mapsmith.plans import cases, relations, shapes  # noqa: F401  registers further queries
from mapsmith.plans.registry import AREA, CELLS, ENDS, JOIN, MEET, NEAR, ORACLES, OVERLAP, QUERIES, comps, query, rounded
from mapsmith.plans.views import duck, features, view

# points -----------------------------------------------------------------------------------------------------------

EPS = 3
POINTS_SQL = f"""WITH RECURSIVE {duck("pts")}, p AS MATERIALIZED (SELECT * FROM pts),
near AS MATERIALIZED (SELECT a.k a, b.k b FROM p a JOIN p b ON a.k < b.k AND {NEAR} <= {EPS * EPS}),
n AS (SELECT a k FROM near UNION SELECT b FROM near), {comps("near", "n")}"""


@query("A8_generalize_points", POINTS_SQL + """,
m AS (SELECT comp, avg(x) x, avg(y) y FROM (SELECT DISTINCT comp, x, y FROM c JOIN p USING (k)) GROUP BY comp),
i AS (SELECT comp, sha256('pointcluster' || string_agg(fid, '' ORDER BY fid)) fid, arg_min(cls, k) cls FROM c JOIN p USING (k) GROUP BY comp)
SELECT fid, cls, round(m.x, 6) x, round(m.y, 6) y, true is_cluster FROM i JOIN m USING (comp)
UNION ALL SELECT fid, cls, CAST(x AS DOUBLE), CAST(y AS DOUBLE), false FROM p WHERE k NOT IN (SELECT k FROM c)""")
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = Features(features(spark, sf_dir, "pts").select("fid", "cls", "geom", "_ord"))
    out = lines.GeneralizePoints(cluster_distance=float(EPS)).execute(data).df
    v = F.element_at(g.vertices("geom"), 1)
    return out.select("fid", "cls", rounded(v[0]).alias("x"), rounded(v[1]).alias("y"), "is_cluster")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir)


@query("G7_dbscan_cluster_ids", POINTS_SQL + """
SELECT p.fid, CASE WHEN comp IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY comp NULLS LAST) - 1 END cluster FROM p LEFT JOIN c USING (k)""")
def cluster_ids(spark, sf_dir):
    return pt.cluster_ids(pt.xy(features(spark, sf_dir, "pts").select("fid", "geom", "_ord")), EPS).select("fid", "cluster")


@query("G8_cluster_centroids", POINTS_SQL + """
SELECT min_by(fid, k) fid, round(sum(v), 4) v, count(*) n, string_agg(fid, ',' ORDER BY k) ids FROM c JOIN p USING (k) GROUP BY comp""")
def centroids(spark, sf_dir):
    out = pt.cluster_centroids(features(spark, sf_dir, "pts").select("fid", "v", "geom", "_ord"), EPS, aggregation_functions={"v": "sum"})
    return out.select("fid", F.round("v", 4).alias("v"), F.size("old_ids").cast("long").alias("n"), F.array_join("old_ids", ",").alias("ids"))


def pushed(table: str, threshold: float) -> str:
    """One pass over ``table`` (k, fid, x, y)."""
    return f"""SELECT p.k, any_value(p.fid) fid, any_value(p.x) + coalesce(sum((p.x - b.x) / d * ({threshold} - d) / 2), 0) x, any_value(p.y) + coalesce(sum((p.y - b.y) / d * ({threshold} - d) / 2), 0) y
FROM {table} p LEFT JOIN LATERAL (SELECT b.x, b.y, sqrt((p.x - b.x) * (p.x - b.x) + (p.y - b.y) * (p.y - b.y)) d FROM {table} b WHERE b.k != p.k AND b.x BETWEEN p.x - {threshold} AND p.x + {threshold} AND b.y BETWEEN p.y - {threshold} AND p.y + {threshold}) b ON d < {threshold} AND d > 0 GROUP BY p.k"""


PASSES = 10


@query("P1_displace_points", f"WITH {duck('pts')}, p0 AS MATERIALIZED (SELECT k, fid, CAST(x AS DOUBLE) x, CAST(y AS DOUBLE) y FROM pts), " + ", ".join(f"p{i + 1} AS MATERIALIZED ({pushed(f'p{i}', 4.0)})" for i in range(PASSES)) + f" SELECT fid, round(x, 6) x, round(y, 6) y FROM p{PASSES}")
def displaced(spark, sf_dir):
    v = F.element_at(g.vertices("geom"), 1)
    return pt.displace(features(spark, sf_dir, "pts").select("fid", "geom", "_ord"), 4.0, PASSES).select("fid", rounded(v[0]).alias("x"), rounded(v[1]).alias("y"))


@query("P3_reduce_by_selecting")
def reduced(spark, sf_dir):
    return pt.reduce_by_selecting(features(spark, sf_dir, "pts").select("fid", "v", "geom", "_ord"), None, 5.0, "v").select("fid")


@query("G9_reduce_by_clustering", f"""WITH RECURSIVE {duck("pts")}, p AS MATERIALIZED (SELECT * FROM pts),
near AS MATERIALIZED (SELECT a.k a, b.k b FROM p a JOIN p b ON a.k < b.k AND {NEAR} < 16), {comps("near", "p")}
SELECT min(k) k, count(*) n FROM c GROUP BY comp""")
def by_clustering(spark, sf_dir):
    out = pt.reduce_by_clustering(features(spark, sf_dir, "pts").select("fid", "k", "geom", "_ord"), 2.0, "k", "members")
    return out.select("k", F.coalesce(F.size("members"), F.lit(1)).cast("long").alias("n"))


# filters ----------------------------------------------------------------------------------------------------------


def area_query(name: str, where: str, f: Callable[[DataFrame], DataFrame]) -> None:
    @query(name, f"WITH {duck('rects')} SELECT fid, CAST({AREA} AS DOUBLE) area FROM rects WHERE {where}")
    def run(spark, sf_dir):
        return f(features(spark, sf_dir, "rects")).select("fid", g.area("geom").alias("area"))


area_query("F3_remove_large_polygons", f"{AREA} <= 100", lambda d: fe.remove_large_polygons(d, 100))
area_query("F4_remove_small_polygons", f"{AREA} >= 100", lambda d: fe.remove_small_polygons(d, 100))
area_query("F9_filter_buildings", f"({AREA} >= 50 AND NOT (cls IN ('Brand#11', 'Brand#12') AND {AREA} < 200)) OR cls = 'Brand#13'", lambda d: fe.filter_buildings(d, "cls", least=50, least_low=200, low=frozenset({"Brand#11", "Brand#12"}), always=frozenset({"Brand#13"})))
area_query("F10_exclude_large_of_class", f"NOT (cls = 'Brand#11' AND {AREA} > 100)", lambda d: fe.exclude_large_of_class(d, "cls", frozenset({"Brand#11"}), 100))
area_query("F15_by_box_side", "greatest(x1 - x0, y1 - y0) > 15", lambda d: fe.by_box_side(d, 15)[0])


@query("F5_remove_short_lines", f"WITH {duck('rects')} SELECT fid, CAST(2 * (x1 - x0 + y1 - y0) AS DOUBLE) n FROM rects WHERE 2 * (x1 - x0 + y1 - y0) >= 60")
def short_lines(spark, sf_dir):
    rims = features(spark, sf_dir, "rects").withColumn("geom", g.boundary("geom"))
    return fe.remove_short_lines(rims, 60).select("fid", g.length("geom").alias("n"))


@query("F11_by_interval", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity % 5 = 0")
def interval(spark, sf_dir):
    return fe.by_interval(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_quantity", 5).select("l_orderkey", "l_linenumber", "l_quantity")


@query("F13_near_far_filter", f"""WITH {duck("rects")}, d AS (SELECT a.k, min(sqrt(power(greatest(0, a.x0 - b.x1, b.x0 - a.x1), 2) + power(greatest(0, a.y0 - b.y1, b.y0 - a.y1), 2))) d FROM rects a JOIN (SELECT * FROM rects WHERE {AREA} > 800) b ON a.k != b.k GROUP BY a.k)
SELECT fid FROM rects LEFT JOIN d USING (k) WHERE {AREA} > CASE WHEN coalesce(d, 1e9) <= 10 THEN 300 ELSE 700 END""")
def near_far(spark, sf_dir):
    r = features(spark, sf_dir, "rects")
    out = sp.nearest_other(r, r.where(g.area("geom") > 800), 10.0)
    return out.where(g.area("geom") > F.when(F.coalesce(F.col("_dist") <= 10, F.lit(False)), 300).otherwise(700)).select("fid")


# joins, overlay, dissolve -----------------------------------------------------------------------------------------


@query("J1_self_intersects", f"WITH {duck('rects')} SELECT a.fid f1, b.fid f2 FROM rects a JOIN rects b ON a.k < b.k AND {MEET}")
def self_meet(spark, sf_dir):
    r = features(spark, sf_dir, "rects").select("fid", "_ord", "geom")
    return sp.sjoin(r, r).where("l._ord < r._ord").select(F.col("l.fid").alias("f1"), F.col("r.fid").alias("f2"))


@query("J4_split_by_points", f"WITH {duck('rects', 'pts')} SELECT fid, EXISTS (SELECT 1 FROM pts p WHERE p.x BETWEEN x0 AND x1 AND p.y BETWEEN y0 AND y1) held FROM rects")
def split_points(spark, sf_dir):
    a, b = sp.split_by_points(features(spark, sf_dir, "rects").select("fid", "geom", "_ord"), features(spark, sf_dir, "pts").select("fid", "geom"))
    return a.select("fid", F.lit(True).alias("held")).unionByName(b.select("fid", F.lit(False).alias("held")))


@query("J5_inherit_first", f"""WITH {duck("rects", "masks")} SELECT a.fid, coalesce(arg_min(b.cls, b.k), (SELECT arg_min(cls, k) FROM rects)) cls
FROM masks a LEFT JOIN rects b ON {MEET} GROUP BY a.fid""")
def first_met(spark, sf_dir):
    return sp.inherit_first(features(spark, sf_dir, "rects").select("fid", "cls", "geom", "_ord"), features(spark, sf_dir, "masks").select("fid", "geom", "_ord")).select("fid", "cls")


@query("J6_inherit_largest", f"""WITH {duck("rects", "masks")}, m AS (SELECT a.k t, b.fid, b.cls, b.k, (b.x1 - b.x0) * (b.y1 - b.y0) s FROM masks a JOIN rects b ON {MEET})
SELECT t, arg_min(fid, -s * 1000000 + k) fid, arg_min(cls, -s * 1000000 + k) cls, string_agg(fid, ',' ORDER BY s DESC, k) ids FROM m GROUP BY t""")
def largest_met(spark, sf_dir):
    out = sp.inherit_largest(features(spark, sf_dir, "rects").select("fid", "cls", "geom", "_ord"), features(spark, sf_dir, "masks").select("fid", "geom", "_ord"), old_ids="old_ids")
    return out.select(F.col("_ord")[0].alias("t"), "fid", "cls", F.array_join("old_ids", ",").alias("ids"))


@query("J11_intersection", f"WITH {duck('rects', 'masks')} SELECT a.fid, count(*) n, CAST(sum({OVERLAP}) AS DOUBLE) area FROM rects a JOIN masks b ON {OVERLAP} > 0 GROUP BY a.fid")
def overlaid(spark, sf_dir):
    out = sp.intersection(features(spark, sf_dir, "rects").select("fid", "geom", "_ord"), features(spark, sf_dir, "masks").select("fid", "geom", "_ord"))
    return out.groupBy("fid").agg(F.count("*").alias("n"), F.sum(g.area("geom")).alias("area"))


DIFFERENCE_SQL = f"""WITH {duck("rects", "masks")}, u AS (SELECT k, fid, cx, unnest(range(y0, y1)) cy FROM ({CELLS.format(t="rects")})), m AS (SELECT DISTINCT cx, unnest(range(y0, y1)) cy FROM ({CELLS.format(t="masks")}))
SELECT fid, CAST(count(*) AS DOUBLE) area FROM u ANTI JOIN m USING (cx, cy) GROUP BY fid"""


@query("J12_difference", DIFFERENCE_SQL)
def without(spark, sf_dir):
    out = sp.difference(features(spark, sf_dir, "rects").select("fid", "geom", "_ord"), features(spark, sf_dir, "masks").select("fid", "geom", "_ord"))
    return out.select("fid", rounded(g.area("geom")).alias("area"))


@query("A18_keep_intersection", f"WITH {duck('rects', 'masks')} SELECT a.cls, CAST({OVERLAP} AS DOUBLE) area, count(*) OVER (PARTITION BY a.k) > 1 hashed FROM rects a JOIN masks b ON {OVERLAP} > 0")
def keep(spark, sf_dir):
    data, mask = Features(features(spark, sf_dir, "rects").select("fid", "cls", "geom", "_ord")), Features(features(spark, sf_dir, "masks").select("fid", "geom", "_ord"))
    out = areas.KeepIntersection().execute(data, {"mask": mask}).df
    return out.select("cls", rounded(g.area("geom")).alias("area"), (F.length("fid") == 64).alias("hashed"))


@query("A19_remove_overlap", DIFFERENCE_SQL)
def remove(spark, sf_dir):
    data, mask = Features(features(spark, sf_dir, "rects").select("fid", "k", "geom", "_ord")), Features(features(spark, sf_dir, "masks").select("fid", "geom", "_ord"))
    out = areas.RemoveOverlap().execute(data, {"mask": mask}).df
    # parts of one row have ids of their own, made from its id and their form
    own = F.col("k").cast("string")
    good = F.when(F.count("*").over(Window.partitionBy("k")) > 1, F.col("fid") == F.sha2(F.concat(F.lit("removeoverlap"), own, g.wkt("geom")), 256)).otherwise(F.col("fid") == own)
    return out.withColumn("_good", good).groupBy("k").agg(rounded(F.sum(g.area("geom"))).alias("area"), F.min("_good").alias("_good")).where("_good").select(F.col("k").cast("string").alias("fid"), "area")


@query("P7_coverage", f"WITH {duck('rects', 'masks')} SELECT a.fid, round(100.0 * coalesce(sum({OVERLAP}), 0) / ((a.x1 - a.x0) * (a.y1 - a.y0)), 6) pct FROM masks a LEFT JOIN rects b ON {OVERLAP} > 0 GROUP BY a.fid, a.x0, a.x1, a.y0, a.y1")
def covered(spark, sf_dir):
    return sp.coverage(features(spark, sf_dir, "masks").select("fid", "geom", "_ord"), features(spark, sf_dir, "rects").select("fid", "geom"), "pct").select("fid", F.round("pct", 6).alias("pct"))


@query("J16_within_distance", f"WITH {duck('pts', 'edges')} SELECT DISTINCT p.fid FROM pts p JOIN edges e ON p.x BETWEEN e.ax - 1 AND e.bx + 1 AND p.y BETWEEN e.ay - 1 AND e.by_ + 1 AND power(greatest(0, e.ax - p.x, p.x - e.bx), 2) + power(greatest(0, e.ay - p.y, p.y - e.by_), 2) <= 1")
def slope(spark, sf_dir):
    data, contours = (Features(features(spark, sf_dir, n).select("fid", "geom", "_ord")) for n in ("pts", "edges"))
    return lines.GeneralizeSlopeLines().execute(data, {"contours": contours}).df.select("fid")


@query("A15_slope_lines", f"WITH {duck('pts', 'edges')} SELECT DISTINCT p.fid FROM pts p JOIN edges e ON power(greatest(0, e.ax * 16 - p.x, p.x - e.bx * 16), 2) + power(greatest(0, e.ay * 16 - p.y, p.y - e.by_ * 16), 2) <= 2 AND p.x BETWEEN e.ax * 16 - 2 AND e.bx * 16 + 2 AND p.y BETWEEN e.ay * 16 - 2 AND e.by_ * 16 + 2")
def slope_lines(spark, sf_dir):
    wide = view(spark, sf_dir, "edges").withColumn("_ord", F.array(F.col("k").cast("long")))
    at = lambda x, y: F.array(*((F.col(c) * 16).cast("double") for c in (x, y)))
    contours = Features(wide.select("fid", g.line(F.array(at("ax", "ay"), at("bx", "by_"))).alias("geom"), "_ord"))
    data = Features(features(spark, sf_dir, "pts").select("fid", "geom", "_ord"))
    return lines.GeneralizeSlopeLines(tolerance=2**0.5).execute(data, {"contours": contours}).df.select("fid")


MEETING = f"near AS MATERIALIZED (SELECT a.k a, b.k b FROM rects a JOIN rects b ON a.k < b.k AND {MEET})"


def rects(spark, sf_dir):
    return features(spark, sf_dir, "rects").select("fid", "cls", "geom", "_ord")


@query("G3_group_by_intersections", f"WITH RECURSIVE {duck('rects')}, {MEETING}, {comps('near', 'rects')} SELECT fid, dense_rank() OVER (ORDER BY comp) grp FROM rects JOIN c USING (k)")
def groups(spark, sf_dir):
    return sp.group_by_intersections(rects(spark, sf_dir), "grp").select("fid", "grp")


@query("A1_dissolve_polygons", f"""WITH RECURSIVE {duck("rects")}, near AS MATERIALIZED (SELECT a.k a, b.k b FROM rects a JOIN rects b ON a.k < b.k AND a.cls = b.cls AND {JOIN}), {comps("near", "rects")},
u AS (SELECT comp, count(DISTINCT (cx, cy)) n FROM (SELECT comp, cx, unnest(range(y0, y1)) cy FROM (SELECT comp, unnest(range(x0, x1)) cx, y0, y1 FROM rects JOIN c USING (k))) GROUP BY comp),
i AS (SELECT comp, any_value(cls) cls, CASE WHEN count(*) > 1 THEN sha256('dissolvepolygons' || string_agg(fid, '' ORDER BY fid)) ELSE any_value(fid) END fid FROM rects JOIN c USING (k) GROUP BY comp)
SELECT fid, cls, CAST(n AS DOUBLE) area FROM i JOIN u USING (comp)""")
def dissolved(spark, sf_dir):
    out = areas.DissolvePolygons(by_column=frozenset({"cls"})).execute(Features(rects(spark, sf_dir))).df
    return out.select("fid", "cls", rounded(g.area("geom")).alias("area"))


G1_SQL = f"""WITH RECURSIVE {duck("masks")}, near AS MATERIALIZED (SELECT a.k a, b.k b FROM masks a JOIN masks b ON a.k < b.k AND {JOIN}), {comps("near", "masks")},
u AS (SELECT comp, count(DISTINCT (cx, cy)) n FROM (SELECT comp, cx, unnest(range(y0, y1)) cy FROM (SELECT comp, unnest(range(x0, x1)) cx, y0, y1 FROM masks JOIN c USING (k))) GROUP BY comp)"""


@query("G1_dissolve_by_least_id", G1_SQL + ", i AS (SELECT comp, string_agg(fid, ',' ORDER BY fid) ids, min(fid) fid FROM masks JOIN c USING (k) GROUP BY comp) SELECT fid, ids, CAST(n AS DOUBLE) area FROM i JOIN u USING (comp)")
def by_least_id(spark, sf_dir):
    out = sp.dissolve(features(spark, sf_dir, "masks").select("fid", "geom", "_ord"), inherit_from="min_id")
    return out.select("fid", F.array_join("old_ids", ",").alias("ids"), rounded(g.area("geom")).alias("area"))


@query("G2_union_parts", G1_SQL + " SELECT CAST(n AS DOUBLE) area FROM u")
def united(spark, sf_dir):
    return sp.union_parts(features(spark, sf_dir, "masks").select("fid", "geom", "_ord")).select(rounded(g.area("geom")).alias("area"))


@query("G6_dissolve_layers", f"SELECT CAST(count(DISTINCT (cx, cy)) AS DOUBLE) area FROM (WITH {duck('masks', 'rects')} SELECT cx, unnest(range(y0, y1)) cy FROM ({CELLS.format(t='masks')} UNION ALL {CELLS.format(t='rects')}))")
def layers(spark, sf_dir):
    m, r = (features(spark, sf_dir, n).select("fid", "geom", "_ord") for n in ("masks", "rects"))
    return sp.dissolve_layers([m, r]).agg(rounded(F.sum(g.area("geom"))).alias("area"))


# identity ---------------------------------------------------------------------------------------------------------


@query("I1_hash_duplicates", f"WITH {duck('pts')}, d AS (SELECT CAST(k % 700 AS VARCHAR) fid, k, x, y FROM pts) SELECT k, CASE WHEN count(*) OVER (PARTITION BY fid) > 1 THEN sha256('test' || fid || 'POINT (' || x || ' ' || y || ')') ELSE fid END fid FROM d")
def duplicates(spark, sf_dir):
    return fe.hash_duplicates(features(spark, sf_dir, "pts").withColumn("fid", (F.col("k") % 700).cast("string")), "test").select("k", "fid")


@query("I2_hash_old_ids", f"WITH {duck('pts')} SELECT cls, CAST(k % 90 AS BIGINT) grp, CASE WHEN count(*) > 1 THEN sha256('test' || string_agg(fid, '' ORDER BY fid)) ELSE min(fid) END fid FROM pts GROUP BY cls, k % 90")
def old_ids(spark, sf_dir):
    by = view(spark, sf_dir, "pts").groupBy("cls", (F.col("k") % 90).alias("grp")).agg(F.collect_list("fid").alias("old_ids"), F.min("fid").alias("fid"))
    return fe.hash_old_ids(by, "test").select("cls", "grp", "fid")


@query("I3_hash_geometry", f"WITH {duck('pts')} SELECT k, sha256('test' || 'POINT (' || x || ' ' || y || ')') fid FROM pts")
def hashed(spark, sf_dir):
    return fe.hash_geometry(features(spark, sf_dir, "pts"), "test").select("k", "fid")


# coordinates ------------------------------------------------------------------------------------------------------


def triangle(spark, sf_dir):
    """Lines of three vertices: a point, the next two along its own numbers."""
    p = view(spark, sf_dir, "pts").where("x != y")
    at = lambda x, y, z: F.array(x.cast("double"), y.cast("double"), z.cast("double"))
    return p.select("fid", F.array(at(F.col("x"), F.col("y"), F.col("k") % 7), at(F.col("y"), F.col("x"), F.col("k") % 5), at(F.col("y") + 3, F.col("x") + 4, F.col("k") % 3)).alias("line"))


@query("S25_S29_line_measures", f"""WITH {duck("pts")} SELECT fid, round((degrees(atan2(x - y, y - x)) + 360) % 360, 6) bearing, round((degrees(atan2(x - y, y - x)) + 180) % 180, 6) direction,
round(((degrees(atan2(x - y, y - x)) + 180) % 180 + degrees(atan2(4, 3))) / 2, 6) mean_direction, round(sqrt(2.0 * (x - y) * (x - y)) + 5, 6) n, round((k % 7 + k % 5 + k % 3) / 3.0, 6) z, CAST(least(k % 7, k % 5, k % 3) AS DOUBLE) zmin FROM pts WHERE x != y""")
def measures(spark, sf_dir):
    t = triangle(spark, sf_dir)
    line = F.col("line")
    return t.select("fid", F.round(co.bearing(line[0], line[1]), 6).alias("bearing"), F.round(co.direction(line[0], line[1]), 6).alias("direction"), F.round(co.mean_direction(line), 6).alias("mean_direction"), F.round(co.line_length(line), 6).alias("n"), F.round(co.mean_z(line), 6).alias("z"), co.equalize_z(line, "min")[1][2].alias("zmin"))


@query("S14_S19_line_edits", f"""WITH {duck("pts")} SELECT fid, CAST(10 AS DOUBLE) scaled, round(y + 3 + 10 * 0.6, 6) ex, round(x + 4 + 10 * 0.8, 6) ey, CAST(4 AS BIGINT) inserted, CAST(5 AS BIGINT) joined, CAST(y + 3 AS DOUBLE) turned FROM pts WHERE x != y""")
def edits(spark, sf_dir):
    t = triangle(spark, sf_dir)
    line = F.col("line")
    end = F.element_at(co.extend(line, 10.0, co.ExtendFrom.END), -1)
    return t.select("fid", F.round(co.line_length(co.scale_to_length(line, 10.0)), 6).alias("scaled"), F.round(end[0], 6).alias("ex"), F.round(end[1], 6).alias("ey"), F.size(co.insert_vertex(line, F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)), -1)).cast("long").alias("inserted"), F.size(co.concatenate(line, F.reverse(line))).cast("long").alias("joined"), co.orient_toward(line, line[0], True)[0][0].alias("turned"))


@query("S3_chaikin", f"WITH {duck('rects')} SELECT fid, round({AREA} * 0.875, 6) area FROM rects")
def chaikin(spark, sf_dir):
    return features(spark, sf_dir, "rects").select("fid", rounded(g.area(g.call("smooth", "geom", F.array().cast("array<binary>"), F.lit(1)))).alias("area"))


@query("S10_S11_box", f"WITH {duck('rects')} SELECT fid, CAST(least(x1 - x0, y1 - y0) AS DOUBLE) width, CAST(greatest(x1 - x0, y1 - y0) AS DOUBLE) height, round(least(x1 - x0, y1 - y0) / greatest(x1 - x0, y1 - y0), 6) ratio FROM rects")
def box(spark, sf_dir):
    b = g.call("box", "geom")
    return features(spark, sf_dir, "rects").select("fid", rounded(b[0]).alias("width"), rounded(b[1]).alias("height"), rounded(fe.elongation()).alias("ratio"))


@query("S5_topological_points", f"""WITH {duck("rects")}, v AS (SELECT x0 x, y0 y FROM rects UNION SELECT x1, y0 FROM rects UNION SELECT x0, y1 FROM rects UNION SELECT x1, y1 FROM rects)
SELECT CAST(x AS DOUBLE) x, CAST(y AS DOUBLE) y, count(*) n FROM v JOIN rects ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY x, y HAVING count(*) > 1""")
def shared_points(spark, sf_dir):
    return sp.topological_points(rects(spark, sf_dir)).select("x", "y", "n")


# networks ---------------------------------------------------------------------------------------------------------

@query("N1_endpoints", f"WITH {duck('edges')}, {ENDS} SELECT fid, CAST(side AS INTEGER) side, CAST(x AS DOUBLE) x, CAST(y AS DOUBLE) y, count(*) OVER (PARTITION BY x, y) n FROM e")
def ends(spark, sf_dir):
    return nw.endpoints(features(spark, sf_dir, "edges")).select("fid", "side", "x", "y", "n")


@query("N2_remove_disconnected_short", f"WITH {duck('edges')}, {ENDS}, s AS (SELECT k, count(*) OVER (PARTITION BY x, y) > 1 shared FROM e) SELECT fid FROM edges JOIN (SELECT k FROM s GROUP BY k HAVING bool_and(shared)) USING (k)")
def connected(spark, sf_dir):
    return nw.remove_disconnected_short(features(spark, sf_dir, "edges").select("fid", "geom", "_ord"), 2.0).select("fid")


@query("N6_dead_ends", f"WITH {duck('edges')}, {ENDS}, s AS (SELECT k, side, count(*) OVER (PARTITION BY x, y) > 1 met FROM e) SELECT fid, count(*) FILTER (WHERE met) = 1 dead FROM s JOIN edges USING (k) GROUP BY fid")
def dead(spark, sf_dir):
    normal, ends_ = nw.dead_ends(features(spark, sf_dir, "edges").select("fid", "geom", "_ord"), 0.0, "dead")
    return normal.select("fid", "dead").unionByName(ends_.select("fid", "dead"))


@query("N16_count_connections", f"WITH {duck('edges')}, {ENDS}, s AS (SELECT k, side, count(*) OVER (PARTITION BY x, y) - 1 n FROM e) SELECT fid, CAST(sum(n) FILTER (WHERE side = 0) AS BIGINT) start_count, CAST(sum(n) FILTER (WHERE side = 1) AS BIGINT) end_count FROM s JOIN edges USING (k) GROUP BY fid")
def counts(spark, sf_dir):
    return nw.count_connections(features(spark, sf_dir, "edges").select("fid", "geom", "_ord")).select("fid", "start_count", "end_count")


CHAINS = f"""WITH RECURSIVE {duck("edges")}, {ENDS}, j AS MATERIALIZED (SELECT x, y, count(*) n, min(k) a, max(k) b FROM e GROUP BY x, y), near AS (SELECT a, b FROM j WHERE n = 2 AND a != b), {comps("near", "edges")}, z AS MATERIALIZED (SELECT comp, count(*) n FROM c GROUP BY comp),
o AS (SELECT comp, count(*) FILTER (WHERE j.n > 2) met, count(*) outer_ FROM e JOIN c USING (k) JOIN j USING (x, y) WHERE j.n != 2 GROUP BY comp)"""


@query("N13_contiguous", CHAINS + " SELECT fid, CAST(z.n AS DOUBLE) n, coalesce(met = 1 AND outer_ = 2, false) dead, coalesce(met = 0 AND outer_ = 2, false) apart FROM edges JOIN c USING (k) JOIN z USING (comp) LEFT JOIN o USING (comp)")
def contiguous(spark, sf_dir):
    out = nw.contiguous(features(spark, sf_dir, "edges").select("fid", "geom", "_ord"), length="n", dead="dead", apart="apart")
    return out.select("fid", rounded(F.col("n")).alias("n"), "dead", "apart")


@query("A13_generalize_roads", CHAINS + " SELECT fid FROM edges JOIN c USING (k) JOIN z USING (comp) LEFT JOIN o USING (comp) WHERE NOT (z.n <= 4 AND coalesce(outer_ = 2 AND met < 2, false))")
def roads(spark, sf_dir):
    data = Features(features(spark, sf_dir, "edges").select("fid", "cls", "geom", "_ord"))
    return lines.GeneralizeRoads(threshold_length=4.0).execute(data).df.select("fid")


MERGED = f"""WITH RECURSIVE {duck("edges")}, {ENDS}, j AS MATERIALIZED (SELECT x, y, cls, count(*) n, min(k) a, max(k) b FROM e JOIN edges USING (k) GROUP BY x, y, cls), near AS (SELECT a, b FROM j WHERE n = 2 AND a != b), {comps("near", "edges")},
m AS (SELECT comp, any_value(cls) cls, list(fid ORDER BY fid) ids, count(*) n FROM edges JOIN c USING (k) GROUP BY comp)"""


@query("G4_merge_by_attribute", MERGED + " SELECT array_to_string(ids, ',') ids, CAST(n AS DOUBLE) n FROM m")
def merged(spark, sf_dir):
    out = nw.merge_by_attribute(features(spark, sf_dir, "edges").select("fid", "cls", "geom", "_ord"), "cls")
    return out.select(F.array_join("old_ids", ",").alias("ids"), rounded(g.length("geom")).alias("n"))


@query("I7_fence_ids", MERGED + " SELECT sha256('generalize_fences' || array_to_string(ids, '')) fid FROM m")
def fence_ids(spark, sf_dir):
    return lines.merged_fences(features(spark, sf_dir, "edges").select("fid", "cls", "geom", "_ord"), "cls").select("fid")


@query("N18_cluster_graph", f"""WITH RECURSIVE {duck("edges")}, near AS (SELECT ax * 100000 + ay a, bx * 100000 + by_ b FROM edges), nodes AS (SELECT a k FROM near UNION SELECT b FROM near), {comps("near", "nodes")},
z AS (SELECT comp, count(*) size FROM c GROUP BY comp) SELECT k // 100000 || '.0 ' || k % 100000 || '.0' node, size FROM c JOIN z USING (comp)""")
def clusters(spark, sf_dir):
    out = nw.cluster_graph(nw.graph_edges(features(spark, sf_dir, "edges").select("fid", "geom", "_ord")), 2.0)
    return out.select("node", F.count("*").over(Window.partitionBy("component")).alias("size"))


@query("N22_split_by_points", f"""WITH {duck("edges", "pts")}, w AS (SELECT k, fid, ax * 8 ax, ay, bx * 8 bx FROM edges_right)
SELECT w.fid, count(DISTINCT p.x) + 1 pieces, CAST(8 AS DOUBLE) n FROM w LEFT JOIN pts p ON p.y = w.ay AND p.x > w.ax AND p.x < w.bx GROUP BY w.fid""")
def pieces(spark, sf_dir):
    e = view(spark, sf_dir, "edges_right").withColumn("_ord", F.array(F.col("k").cast("long")))
    g.install(spark)
    at = lambda x: F.array((F.col(x) * 8).cast("double"), F.col("ay").cast("double"))
    wide = e.select("fid", "_ord", g.line(F.array(at("ax"), at("bx"))).alias("geom"))
    out = nw.split_by_points(wide, features(spark, sf_dir, "pts").select("geom"), 0.5)
    return out.groupBy("fid").agg(F.count("*").alias("pieces"), rounded(F.sum(g.length("geom"))).alias("n"))


@query("W1_rank_parallel", f"WITH {duck('pts')}, p AS (SELECT k, cls, y + k / 1e6 d, min(y + k / 1e6) OVER (PARTITION BY cls) FROM pts) SELECT cls, k, CAST(rank() OVER (PARTITION BY cls ORDER BY d) AS DOUBLE) rnk FROM p")
def ranked(spark, sf_dir):
    p = view(spark, sf_dir, "pts")
    g.install(spark)
    y = F.col("y") + F.col("k") / 1e6
    rows = p.select("fid", "cls", "k", F.array(F.col("k").cast("long")).alias("_ord"), g.line(F.array(F.array(F.lit(-2000.0), y), F.array(F.lit(2000.0), y))).alias("geom"))
    return lines.rank_parallel(rows, "cls").select("cls", "k", F.col("_rank").alias("rnk"))


# algorithms over whole views, most without SQL -------------------------------------------------------------------------------------------


def algorithm(name: str, command: str, view_name: str, refs: dict[str, str] | None = None, oracle: str | None = None, **parameters) -> None:
    """Summary of an algorithm's result over all rows of a view: rows, and their rounded measures."""

    @query(name, oracle)
    def run(spark, sf_dir):
        columns = ["fid", "cls", "geom", "_ord"]
        data = Features(features(spark, sf_dir, view_name).withColumn("elevation_value", F.col("k") % 10).select(*columns, "elevation_value"))
        given = {k: Features(features(spark, sf_dir, v).select("fid", "geom", "_ord")) for k, v in (refs or {}).items()}
        out = ALGORITHMS[command](**parameters).execute(data, given).df
        return out.select("fid", g.geom_type("geom").alias("kind"), F.round(g.area("geom"), 3).alias("area"), F.round(g.length("geom"), 3).alias("n"))


algorithm("A2_building_areas", "building_areas", "rects", {"roads": "edges_right", "parcels": "masks"}, threshold_building_area_far=900.0, threshold_building_area_near=300.0)
algorithm("A3_buildings", "buildings", "rects", None, building_class_column="cls", side_threshold=20, point_size=5, minimum_distance_to_isolated_building=10)
algorithm(
    "A4_cliffs", "cliffs", "edges", {"roads": "edges_up"},
    f"WITH {duck('edges')}, u AS (SELECT ax x, ay y FROM edges_up UNION SELECT bx, by_ FROM edges_up) SELECT fid, 'LineString' kind, 0.0 area, CAST(1 - 0.2 * (EXISTS (SELECT 1 FROM u WHERE u.x = r.ax AND u.y = r.ay))::INT - 0.2 * (EXISTS (SELECT 1 FROM u WHERE u.x = r.bx AND u.y = r.by_))::INT AS DOUBLE) n FROM edges_right r",
    buffer_size=0.2, length_threshold=0.1,
)
algorithm("A5_conservation_areas", "conservation_areas", "rects", {"water_areas": "masks"}, area_threshold=100.0)
algorithm("A6_contours", "contours", "edges", {"slope": "pts"}, length_threshold=1.0, gaussian_filter_strength=0.2)
algorithm("A7_fences", "fences", "edges", {"masts": "pts"}, attribute_for_line_merge="cls", gap_threshold=0.5, fence_length_threshold=2, fence_length_threshold_in_closed_area=3, simplification_tolerance=0.1, closing_fence_area_threshold=2, closing_fence_area_with_mast_threshold=4)
algorithm("A9_landcover", "landcover", "rects", None, positive_buffer=3, negative_buffer=-3, simplification_tolerance=1, area_threshold=100, hole_threshold=50)
algorithm(
    "A10_polygons_to_points", "polygons_to_points", "rects", None,
    f"WITH {duck('rects')} SELECT fid, CASE WHEN {AREA} >= 200 THEN 'Polygon' ELSE 'Point' END kind, CAST(CASE WHEN {AREA} >= 200 THEN {AREA} ELSE 0 END AS DOUBLE) area, CAST(CASE WHEN {AREA} >= 200 THEN 2 * (x1 - x0 + y1 - y0) ELSE 0 END AS DOUBLE) n FROM rects",
    polygon_min_area=200.0,
)
algorithm("A11_power_lines", "power_lines", "edges", {"fences": "edges_up", "substations": "masks"}, class_column="cls", length_threshold=2.0, distance_threshold_for_parallel_lines=0.4, classes_for_higher_priority_lines=frozenset({"1-URGENT"}))
algorithm("A12_railroads", "railroads", "edges", None, fan_minimum_length=3, fan_rail_parallel_distance=1.2, pack_cluster_length_threshold=2, pack_track_maximum_length=6)
algorithm("A14_shared_paths", "shared_paths", "edges", {"roads": "edges_right"}, f"WITH {duck('edges')} SELECT fid, 'LineString' kind, 0.0 area, 1.0 n FROM edges_up", detection_distance=0.3)
algorithm("A16_water_areas", "water_areas", "rects", {"shoreline": "edges_right"}, min_area=100, area_simplification_tolerance=1, thin_section_width=4, thin_section_min_size=5, thin_section_exaggerate_by=0.5)
algorithm("A17_watercourse_areas", "watercourse_areas", "rects", None, min_area=100, area_simplification_tolerance=1, thin_section_width=4, line_transform_width=8, line_min_length=5, min_new_section_length=6)
