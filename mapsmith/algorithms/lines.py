"""Algorithms on points and lines."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any, ClassVar

from pydantic import Field
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapsmith.algorithms.areas import LINE, POLYGON, Values
from mapsmith.algorithms.base import Algorithm, Reference
from mapsmith.functions import coordinates as co
from mapsmith.functions import geometry as g
from mapsmith.operators import features as fe
from mapsmith.operators import network as nw
from mapsmith.operators import points as pt
from mapsmith.operators import spatial as sp
from mapsmith.operators.components import components
from mapsmith.operators.model import ord_part, ord_under
from mapsmith.plans.cutting import cut

LINES = frozenset({"LineString", "MultiLineString"})
POINT = frozenset({"Point"})


class GeneralizePoints(Algorithm):
    """A8"""

    accepts: ClassVar = POINT
    needs_projected: ClassVar = False
    displace: bool = Field(False, description="whether points are pushed apart")
    displace_threshold: float = Field(70.0, gt=0, description="distance that they get")
    displace_points_iterations: int = Field(10, gt=0, description="passes")
    cluster_distance: float = Field(20.0, gt=0, description="points nearer than this make a cluster")
    aggregation_functions: Mapping[str, str | Callable[..., Any]] | None = Field(None, description="aggregate of each column")
    is_cluster_column: str | None = Field("is_cluster", description="column that marks clusters")

    def _execute(self, df, ref):
        made = cut(pt.cluster_centroids(df, self.cluster_distance, aggregation_functions=self.aggregation_functions), "centroids").drop("_x", "_y")
        new = made.withColumn("fid", F.sha2(F.concat(F.lit("pointcluster"), F.array_join(F.array_sort("old_ids"), "")), 256))
        rest = fe.without_members(df, made)
        if self.is_cluster_column:
            new, rest = new.withColumn(self.is_cluster_column, F.lit(True)), rest.withColumn(self.is_cluster_column, F.lit(False))
        out = new.drop("old_ids").unionByName(rest)
        return pt.displace(out, self.displace_threshold, self.displace_points_iterations) if self.displace else out


class GeneralizeSlopeLines(Algorithm):
    """A15"""

    accepts: ClassVar = POINT
    references: ClassVar = {"reference_key": Reference(LINE, True)}
    tolerance: float = Field(1.0, ge=0, description="distance to a contour")
    reference_key: str = Field("contours", description="key of the contours")

    def _execute(self, df, ref):
        contours = ref["reference_key"]
        if contours.isEmpty():
            return df
        return sp.semi(df, contours, "dwithin", distance=self.tolerance)


class GeneralizeRoads(Algorithm):
    """A13; threshold_distance is accepted and has no effect."""

    accepts: ClassVar = LINE
    references: ClassVar = {"reference_key": Reference(LINE)}
    threshold_distance: float = Field(10.0, gt=0, description="without effect")
    threshold_length: float = Field(75.0, gt=0, description="shorter dead ends and lone roads go")
    reference_key: str = Field("network", description="key of a further network")

    def _execute(self, df, ref):
        out = nw.contiguous(df, ref.get("reference_key"), length="_n", dead="_dead", apart="_apart")
        return fe.only(fe.prune_network(out, self.threshold_length, length="_n", dead="_dead", apart="_apart"), df.columns)


class GeneralizeSharedPaths(Algorithm):
    """A14; paths that run along roads for more than ``minimum_percentage`` go."""

    accepts: ClassVar = LINE
    references: ClassVar = {"reference_key": Reference(LINE, True)}
    detection_distance: float = Field(25.0, gt=0, description="what counts as along a road")
    minimum_percentage: float = Field(90.0, ge=0, le=100, description="share of a path along roads")
    reference_key: str = Field("roads", description="key of the roads")

    def _execute(self, df, ref):
        roads = ref["reference_key"]

        def independent(lines: DataFrame) -> DataFrame:
            return sp.along_references(lines, roads, self.detection_distance, self.minimum_percentage).where(~F.col("_along")).drop("_along")

        return sp.nearest_z(nw.reconnect(df, independent, roads, tolerance=1.25 * self.detection_distance), df)


class GeneralizeCliffs(Algorithm):
    """A4"""

    accepts: ClassVar = LINES
    references: ClassVar = {"reference_key": Reference(LINES, True)}
    buffer_size: float = Field(20.0, gt=0, description="room left for roads")
    length_threshold: float = Field(50.0, gt=0, description="shorter cliffs go")
    reference_key: str = Field("roads", description="key of the roads")

    def _execute(self, df, ref):
        return fe.explode_and_hash(fe.remove_short_lines(sp.remove_close_segments(df, ref["reference_key"], self.buffer_size), self.length_threshold), "cliffs")


class GeneralizeContours(Algorithm):
    """A6"""

    accepts: ClassVar = LINE
    references: ClassVar = {"reference_key": Reference(POINT)}
    interval: float = Field(5, gt=0, description="levels that stay")
    gaussian_filter_strength: float = Field(8, ge=0, description="smoothing")
    length_threshold: float = Field(200, ge=0, description="shorter contours go")
    level_attribute: str = Field("elevation_value", description="column of the level")
    reference_key: str = Field("slope", description="key of the slope marks")

    def _execute(self, df, ref):
        own = fe.by_interval(df, self.level_attribute, self.interval).withColumn("geom", g.call("flat", "geom"))
        if "reference_key" in ref:
            own = nw.split_by_points(own, ref["reference_key"].withColumn("geom", g.call("flat", "geom")), 1.0)
        own = cut(own.withColumn("geom", g.with_double("gauss", "geom", self.gaussian_filter_strength)), "contours")
        whole = nw.contiguous(own, length="_n", dead="_dead", apart="_apart").where(F.col("_n") >= self.length_threshold).select(df.columns)
        whole = nw.smooth_connections(whole)
        return fe.z_from_attribute(fe.hash_duplicates(whole, "contour"), self.level_attribute).select(df.columns)


def merged_fences(df: DataFrame, attribute: str) -> DataFrame:
    """Lines merged by attribute, with ids made from those of their sources."""
    merged = nw.merge_by_attribute(df, attribute)
    return merged.withColumn("fid", F.sha2(F.concat(F.lit("generalize_fences"), F.array_join("old_ids", "")), 256)).select(df.columns)


class GeneralizeFences(Algorithm):
    """A7"""

    accepts: ClassVar = LINE
    references: ClassVar = {"reference_key": Reference(POINT, True)}
    closing_fence_area_threshold: float = Field(2000.0, gt=0, description="smaller enclosures are opened")
    closing_fence_area_with_mast_threshold: float = Field(8000.0, gt=0, description="the same with a mast inside")
    fence_length_threshold: float = Field(80.0, gt=0, description="shorter lone fences go")
    fence_length_threshold_in_closed_area: float = Field(300.0, gt=0, description="shorter fences inside enclosures go")
    simplification_tolerance: float = Field(4.0, gt=0, description="tolerance")
    gap_threshold: float = Field(25.0, gt=0, description="narrower gaps are closed")
    attribute_for_line_merge: str = Field("kohdeluokka", description="column whose values must agree")
    reference_key: str = Field("masts", description="key of the masts")

    def _execute(self, df, ref):
        if self.attribute_for_line_merge not in df.columns:
            raise KeyError(self.attribute_for_line_merge)
        merged = cut(merged_fences(df, self.attribute_for_line_merge), "fences")
        closed = cut(nw.connect_near_ends(merged, self.gap_threshold), "closed")
        areas = nw.faces(closed)
        within = sp.sjoin(merged.where(g.length("geom") < self.fence_length_threshold_in_closed_area).select("_ord", "geom"), areas, "within").select(F.col("l._ord").alias("_ord")).distinct()
        kept = merged.join(within, "_ord", "left_anti").select(merged.columns)
        with_mast, without = sp.split_by_points(areas, ref["reference_key"])
        small = fe.remove_large_polygons(with_mast, self.closing_fence_area_with_mast_threshold).unionByName(fe.remove_large_polygons(without, self.closing_fence_area_threshold))
        kept = cut(fe.drop_empty(sp.lines_off_polygon_edges(kept, cut(small, "small"))), "kept")
        kept = nw.remove_disconnected_short(kept, self.fence_length_threshold)
        return sp.nearest_z(kept.withColumn("geom", g.with_double("simplify", "geom", self.simplification_tolerance)), df)


def segments_of(df: DataFrame, longest: float = 0.0) -> DataFrame:
    """(seg, _ord, fid, geom) of the segments of lines, cut to pieces of ``longest`` at most if that is positive; seg
    is their order."""
    geom = g.with_double("dense", "geom", longest) if longest > 0 else F.col("geom")
    row = df.select("_ord", "fid", F.posexplode(g.call("segments", geom)).alias("_k", "geom"))
    return row.select(ord_part("_k").alias("seg"), "_ord", "fid", "geom")


def parallel_segments(df: DataFrame, distance: float, most: float, *, longest: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Segments with their bearing (drawn in one sense, as normalised lines are), and the pairs (a, b) of seg of which
    b meets the flat buffer of a, not a itself, and their bearings differ by less than ``most`` degrees, not taken
    round the circle (P10)."""
    v = g.vertices(g.call("norm", "geom"))
    seg = cut(segments_of(df, longest).withColumn("bearing", co.bearing(F.element_at(v, 1), F.element_at(v, -1))), "segments")
    around = cut(seg.select("seg", "bearing", F.col("geom").alias("line"), g.buffer(g.buffer("geom", distance, "flat"), 0.01, "square").alias("geom")), "around")
    found = lambda: F.transform(g.call("parallels", "_l.geom", "_l.line", "_l.bearing", "_r.geom", "_r.bearing", F.lit(float(most))), lambda js: F.transform(js, lambda j: F.get("_r", j)["seg"]))
    met = sp.by_cell(around, seg.select("seg", "bearing", "geom"), _b=found).select(F.col("seg").alias("a"), F.explode("_b").alias("b"))
    return seg, cut(met.where("a != b"), "parallel")


def flag_parallel(df: DataFrame, distance: float, most: float, *, longest: float = 0.0) -> DataFrame:
    """(seg, _ord, fid, geom, bearing, parallel_with, parallel_group) of the segments that have a parallel partner;
    groups are the components of partners (P10)."""
    seg, met = parallel_segments(df, distance, most, longest=longest)
    partners = met.groupBy(F.col("a").alias("seg")).agg(F.array_sort(F.collect_set("b")).alias("parallel_with"))
    group = components(met, "a", "b").select(F.col("node").alias("seg"), F.col("component").alias("parallel_group"))
    return seg.join(partners, "seg").join(group, "seg").select("seg", "_ord", "fid", "geom", "bearing", "parallel_with", "parallel_group")


def areas_of_parallel_lines(df: DataFrame, distance: float, *, most: float = 10.0, longest: float = 50.0, convex: bool = False) -> DataFrame:
    """(fid, geom, _ord, parallel_direction): hulls of segments and their partners, united by group and then by the
    group's mean bearing rounded to tens (P11, G10)."""
    seg, met = parallel_segments(df, distance, most, longest=longest)
    both = met.join(seg.select(F.col("seg").alias("b"), F.col("geom").alias("_gb")), "b")
    with_ = both.groupBy("a").agg(F.collect_list("_gb").alias("_gb")).join(seg.select(F.col("seg").alias("a"), F.col("geom").alias("_ga"), "bearing"), "a")
    lines_ = g.call("collect", F.concat(F.array("_ga"), "_gb"))
    hull = g.call("hull", lines_) if convex else g.with_double("concave", lines_, 0.0)
    group = components(met, "a", "b").select(F.col("node").alias("a"), F.col("component").alias("_group"))
    held = cut(with_.select("a", "bearing", hull.alias("geom")).join(group, "a", "left").withColumn("_group", F.coalesce("_group", "a")), "hulls")
    mean = held.groupBy("_group").agg(F.bround(F.avg("bearing"), -1).alias("parallel_direction"))
    named = held.join(mean, "_group").select(F.col("a").alias("_ord"), F.concat_ws(":", F.transform("a", lambda k: k.cast("string"))).alias("fid"), "geom", "parallel_direction")
    named = cut(named.where(g.area("geom") > 0), "hulls")
    return sp.union_parts(named, by=["parallel_direction"])


def polygonize_parallel(df: DataFrame, distance: float, *, most: float = 15.0, join: str = "round", hole: float = 1000.0) -> DataFrame:
    """(fid, geom, _ord): where lines run beside each other: the hulls of what lies in a segment's flat buffer in
    about its direction, united, small holes filled, thin spikes closed (P12)."""
    seg = cut(segments_of(df), "segments")
    around = seg.select("seg", F.col("geom").alias("line"), g.buffer("geom", distance, "flat", "mitre").alias("geom"))
    met = sp.sjoin(around, seg.select("geom")).groupBy(F.col("l.seg").alias("_ord")).agg(F.first("l.line").alias("line"), F.array_sort(F.collect_set("r.geom")).alias("near"))
    hull = g.call("besidehull", "line", "near", F.lit(float(distance)), F.lit(float(most)))
    hulls = met.select("_ord", F.concat_ws(":", F.transform("_ord", lambda k: k.cast("string"))).alias("fid"), hull.alias("geom")).where("geom IS NOT NULL")
    united = fe.remove_small_holes(sp.union_parts(cut(hulls, "hulls")), hole)
    closed = sp.union_parts(cut(united.withColumn("geom", g.buffer("geom", distance / 10, join=join)), "closed"))
    back = fe.remove_small_holes(fe.drop_empty(closed.withColumn("geom", g.buffer("geom", -distance / 10, join=join))), hole)
    return sp.explode_parts(back)


class GeneralizePowerLines(Algorithm):
    """A11"""

    accepts: ClassVar = LINE
    references: ClassVar = {"reference_key_fences": Reference(LINE, True), "reference_key_substations": Reference(POLYGON, True)}
    distance_threshold_for_parallel_lines: float = Field(50.0, gt=0, description="what counts as side by side")
    classes_for_merge_parallel_lines: Values = Field(frozenset(), description="classes that are merged")
    classes_for_higher_priority_lines: Values = Field(frozenset(), description="classes that others give way to")
    class_column: str = Field("function", description="class column")
    length_threshold: float = Field(100.0, gt=0, description="shorter lone lines go")
    simplification_tolerance: float = Field(0.0, ge=0, description="tolerance")
    reference_key_fences: str = Field("fences", description="key of the fences")
    reference_key_substations: str = Field("substations", description="key of the substations")

    def _execute(self, df, ref):
        fences, stations = ref["reference_key_fences"], ref["reference_key_substations"]
        lone = cut(sp.semi(stations.withColumn("geom", g.buffer("geom", 5)), fences, anti=True).select("_ord").join(stations, "_ord"), "stations")
        d, merging = self.distance_threshold_for_parallel_lines, fe.is_in(self.class_column, self.classes_for_merge_parallel_lines)
        rest = df
        if self.classes_for_merge_parallel_lines:
            merged = self._merge_parallel(df.where(merging), fences, lone)
            rest = cut(df.where(~merging).withColumn("_ord", ord_under(0)).unionByName(merged.withColumn("_ord", ord_under(1))), "powerlines")
        if self.classes_for_higher_priority_lines:
            high = fe.is_in(self.class_column, self.classes_for_higher_priority_lines)
            first = rest.where(high)
            low = nw.reconnect(rest.where(~high), lambda lines: fe.explode_and_hash(sp.remove_close_segments(lines, first, d), "powerlines"), first)
            rest = cut(first.withColumn("_ord", ord_under(0)).unionByName(low.withColumn("_ord", ord_under(1))), "priority")
        if self.simplification_tolerance > 0:
            rest = rest.withColumn("geom", g.with_double("simplify", "geom", self.simplification_tolerance))
        kept = nw.remove_disconnected_short(rest, self.length_threshold)
        return sp.nearest_z(connect_to_centroids(cut(kept, "kept"), lone), df)

    def _merge_parallel(self, side: DataFrame, fences: DataFrame, stations: DataFrame) -> DataFrame:
        """Lines side by side become the centre line of the area that they fill, led on to the fences and stations
        that the area reaches; what is left of them outside is led on to the centre lines."""
        d = self.distance_threshold_for_parallel_lines
        hulls = areas_of_parallel_lines(side, d, most=10.0, convex=True).drop("parallel_direction")
        hulls = cut(hulls.withColumn("geom", g.with_double("removeholes", "geom", float("inf"))), "parallel")
        named = sp.inherit_largest(side, hulls, old_ids="old_ids", measure_by="length").drop("old_ids")
        areas = cut(fe.hash_old_ids(sp.dissolve(cut(named, "parallel"), old_ids="old_ids"), "powerlines"), "areas")
        middle = areas.withColumn("_poly", F.col("geom")).withColumn("geom", g.with_double("center", "geom", 5.0))
        middle = cut(sp.explode_parts(middle).where(g.geom_type("geom") == "LineString"), "middle")
        for reference, tolerance in ((fences, 0.0), (stations, d)):
            flagged = nw.flag_centre_connections(middle, reference, "_poly", start="_cs", end="_ce")
            middle = cut(nw.extend_flagged(flagged, reference, F.col("_cs"), F.col("_ce"), tolerance).drop("_cs", "_ce"), "middle")
        covered = middle.select(g.buffer("_poly", 1).alias("geom"))
        left = nw.reconnect(side, lambda lines: fe.explode_and_hash(sp.difference(lines, covered), "powerlines"), middle)
        both = left.withColumn("_ord", ord_under(0)).unionByName(middle.select(left.columns).withColumn("_ord", ord_under(1)))
        return fe.explode_and_hash(cut(both, "merged"), "powerlines")


def connect_to_centroids(lines: DataFrame, polygons: DataFrame) -> DataFrame:
    """Ends within 0.1 of a polygon are led on to its centroid."""
    both = lines.select("_ord", F.posexplode(F.array(g.start_of("geom"), g.end_of("geom"))).alias("side", "p"))
    at = both.select("_ord", "side", "p", g.point(F.col("p")[0], F.col("p")[1]).alias("geom"))
    met = sp.sjoin(at, polygons.select("geom"), "dwithin", distance=0.1).withColumn("_c", g.centroid("r.geom"))
    best = met.groupBy(F.col("l._ord").alias("_ord"), F.col("l.side").alias("side")).agg(F.min_by("_c", g.distance("l.geom", "_c")).alias("_c"))
    by = best.groupBy("_ord").agg(F.max(F.when(F.col("side") == 0, F.col("_c"))).alias("_a"), F.max(F.when(F.col("side") == 1, F.col("_c"))).alias("_b"))
    none = F.array().cast("array<array<double>>")
    path = F.concat(F.coalesce(g.vertices("_a"), none), g.vertices("geom"), F.coalesce(g.vertices("_b"), none))
    return lines.join(by, "_ord", "left").withColumn("geom", F.when(F.col("_a").isNull() & F.col("_b").isNull(), F.col("geom")).otherwise(g.line(path))).select(lines.columns)


def rank_parallel(df: DataFrame, group: str) -> DataFrame:
    """``df`` with _rank: where each line of a group crosses a line through the middle of their union, across the mean
    direction of all its segments and twice as long as the group's extent to either side; ties share the average
    rank, up to two lines are 0 and 1 in row order, null where it misses (W1)."""
    whole = df.groupBy(group).agg(g.union(F.collect_list("geom")).alias("_u")).select(group, g.centroid("_u").alias("_c"), g.call("meandirection", "_u").alias("_dir"), g.call("envelope", "_u").alias("_e"))
    c, e = F.element_at(g.vertices("_c"), 1), F.col("_e")
    across, far = F.radians(F.col("_dir") + 90), 2 * F.hypot(e[2] - e[0], e[3] - e[1])
    end = lambda s: F.array(c[0] + s * far * F.cos(across), c[1] + s * far * F.sin(across))
    out = df.join(whole.withColumn("_x", g.line(F.array(end(-1), end(1)))), group).withColumn("_hit", g.call("intersects", "geom", "_x"))
    start = g.line(F.array(g.start_of("_x")))
    d = F.when(F.col("_hit"), g.distance(start, g.call("cross", "geom", "_x")))
    hits = F.sum(F.col("_hit").cast("int")).over(Window.partitionBy(group))
    ranked = out.withColumn("_d", d).withColumn("_hits", hits)
    order = Window.partitionBy(group, "_hit").orderBy("_d")
    ties = F.count("*").over(Window.partitionBy(group, "_hit", "_d"))
    place = F.when(F.col("_hits") <= 2, F.row_number().over(Window.partitionBy(group, "_hit").orderBy("_ord")) - 1.0).otherwise(F.rank().over(order) + (ties - 1) / 2.0)
    return ranked.withColumn("_rank", F.when(F.col("_hit"), place)).select(*df.columns, "_rank")


def outermost(df: DataFrame, group: str, *, missed: bool) -> DataFrame:
    """The first and the last of each group by rank (W2), and with ``missed`` those without one; _rank stays."""
    low = F.row_number().over(Window.partitionBy(group).orderBy(F.asc_nulls_last("_rank"), "_ord"))
    high = F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last("_rank"), "_ord"))
    some = (F.col("_rank").isNotNull() & ((F.col("_lo") == 1) | (F.col("_hi") == 1))) | (F.col("_rank").isNull() & F.lit(missed))
    return df.withColumn("_lo", low).withColumn("_hi", high).where(some).drop("_lo", "_hi")


def with_mean_length(df: DataFrame, by: str, column: str, length: str | None = None) -> DataFrame:
    """``df`` with the mean length of the rows of each group."""
    return df.withColumn(column, F.avg(F.col(length) if length else g.length("geom")).over(Window.partitionBy(by)))


def typed_tracks(edges: DataFrame, cluster: float, longest: float) -> DataFrame:
    """(fid, geom, _ord, _code, _kind) of graph edges: tracks within a cluster (of edges shorter than ``cluster``),
    packs of several tracks between the same two places, and free ones; packs of long tracks are free (N19)."""
    node = nw.cluster_graph(edges, cluster)
    named = edges.join(node.select(F.col("node").alias("src"), F.col("component").alias("_u")), "src", "left").join(node.select(F.col("node").alias("dst"), F.col("component").alias("_v")), "dst", "left")
    ends = F.array_sort(F.array(F.coalesce("_u", "src"), F.coalesce("_v", "dst")))
    same = F.col("_u").isNotNull() & F.col("_v").isNotNull() & (F.col("_u") == F.col("_v"))
    coded = named.withColumn("_code", F.when(same, F.lit("cluster_track")).otherwise(F.array_join(ends, "|")))
    sized = with_mean_length(coded, "_code", "_mean", "length").withColumn("_many", F.count("*").over(Window.partitionBy("_code")))
    kind = F.when(F.col("_code") == "cluster_track", F.col("_code")).when((F.col("_many") == 1) | (F.col("_mean") > longest), F.lit("free_track")).otherwise(F.lit("pack_track"))
    return sized.withColumn("_kind", kind).select("fid", "geom", "_ord", "_code", "_kind")


class GeneralizeRailroads(Algorithm):
    """A12"""

    accepts: ClassVar = LINE
    fan_minimum_length: float = Field(400, ge=0, description="shorter dead ends may be part of a fan")
    fan_rail_parallel_distance: float = Field(6, ge=0, description="distance of rails in a fan")
    pack_cluster_length_threshold: float = Field(200, ge=0, description="shorter tracks tie a cluster")
    pack_track_maximum_length: float = Field(1000, ge=0, description="packs of longer tracks stay")

    def _execute(self, df, ref):
        info = cut(nw.contiguous(df, length="_n", dead="_dead", apart="_apart"), "rails")
        fan = info.where((F.col("_n") < self.fan_minimum_length) & F.col("_dead")).select(df.columns)
        areas = polygonize_parallel(fan, self.fan_rail_parallel_distance).withColumn("geom", g.buffer(g.buffer("geom", -4), 4)).where(~g.is_empty("geom"))
        areas = cut(areas.select("geom", F.col("_ord").alias("_area")), "fans")
        met = sp.sjoin(fan.select("_ord", "geom"), areas).groupBy(F.col("l._ord").alias("_ord")).agg(F.max("r._area").alias("_area"))
        held = cut(fan.join(met, "_ord"), "fan")
        thinned = outermost(rank_parallel(held, "_area"), "_area", missed=False).select("fid", "geom", "_ord")
        rest = cut(info.select(df.columns).join(held.select("_ord"), "_ord", "left_anti"), "rest")

        whole = nw.chains(rest).groupBy("_comp").agg(g.call("merge", g.call("collect", F.collect_list("geom"))).alias("geom"))
        tracks = cut(sp.explode_parts(whole.select(F.col("_comp").cast("string").alias("fid"), "geom", F.col("_comp").alias("_ord"))), "tracks")
        edges = cut(nw.graph_edges(tracks), "graph")
        coded = cut(typed_tracks(edges, self.pack_cluster_length_threshold, self.pack_track_maximum_length), "coded")
        packs = outermost(rank_parallel(coded.where("_kind = 'pack_track'"), "_code"), "_code", missed=True)
        packs = packs.select("fid", "geom", "_ord", F.when(F.col("_rank").isNull(), "free_track").otherwise(F.col("_kind")).alias("_kind"))
        typed = packs.unionByName(coded.where("_kind != 'pack_track'").select("fid", "geom", "_ord", "_kind"))
        kept = typed.withColumn("_ord", ord_under(0)).unionByName(thinned.withColumn("_ord", ord_under(1)).withColumn("_kind", F.lit("fan_track")))
        kept = nw.prune_to_fixpoint(kept, "_kind", "cluster_track")
        kept = nw.end_touches(kept, kept).where("first_intersects OR last_intersects").select("fid", "geom", "_ord")
        return fe.hash_duplicates(sp.inherit_largest(df, kept, measure_by="length"), "railroads").select(df.columns)
