"""Algorithms on polygons: dissolving, land cover, conservation areas, buildings, building areas, water."""

from __future__ import annotations

from typing import ClassVar, Literal

from pydantic import Field
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapsmith.algorithms.base import Algorithm, Reference
from mapsmith.functions import geometry as g
from mapsmith.operators import features as fe
from mapsmith.operators import spatial as sp
from mapsmith.operators.model import GEOMETRY_TYPES, ord_part, ord_under
from mapsmith.operators.points import reduce_by_selecting
from mapsmith.plans.cutting import cut

POLYGON, MULTI = frozenset({"Polygon"}), frozenset({"Polygon", "MultiPolygon"})
LINE = frozenset({"LineString"})
ALL = GEOMETRY_TYPES - {"GeometryCollection"}
Values = frozenset[int | str]


class DissolvePolygons(Algorithm):
    """A1"""

    accepts: ClassVar = POLYGON
    needs_projected: ClassVar = False
    hash_prefix: str = Field("dissolvepolygons", description="start of hashed ids")
    by_column: frozenset[str] = Field(frozenset(), description="columns whose values must agree")
    inherit_from: Literal["min_id", "most_intersection"] = Field("most_intersection", description="whose attributes a group gets")

    def _execute(self, df, ref):
        return fe.hash_old_ids(sp.dissolve(df, by=sorted(self.by_column), inherit_from=self.inherit_from), self.hash_prefix)


class KeepIntersection(Algorithm):
    """A18"""

    accepts: ClassVar = ALL
    needs_projected: ClassVar = False
    references: ClassVar = {"reference_key": Reference(MULTI, True)}
    reference_key: str = Field("mask", description="key of the mask")

    def _execute(self, df, ref):
        # how often an id comes is counted by row before the pieces are made: those are as many as the pairs
        pieces = sp.by_cell(df, ref["reference_key"].select("geom"), _cuts=lambda: g.call("cuts", "_l.geom", "_r.geom"))
        n = F.aggregate("_cuts", F.lit(0), lambda k, c: k + F.size(g.dump(c)))
        counts = pieces.select("fid", n.alias("_n")).groupBy("fid").agg((F.sum("_n") > 1).alias("_many"))
        held = sp.intersection(df.join(cut(counts, "pieces"), "fid"), ref["reference_key"])
        out = sp.explode_parts(held)
        return out.withColumn("fid", F.when(F.col("_many"), fe.hashed_id("keepintersection")).otherwise(F.col("fid"))).select(df.columns)


class RemoveOverlap(Algorithm):
    """A19"""

    accepts: ClassVar = ALL
    needs_projected: ClassVar = False
    references: ClassVar = {"reference_key": Reference(MULTI, True)}
    reference_key: str = Field("mask", description="key of the mask")

    def _execute(self, df, ref):
        return fe.explode_and_hash(sp.difference(df, ref["reference_key"]), "removeoverlap")


class GeneralizePolygonsToPoints(Algorithm):
    """A10"""

    accepts: ClassVar = POLYGON
    polygon_min_area: float = Field(4000.0, gt=0, description="smaller polygons become points")

    def _execute(self, df, ref):
        return fe.polygons_to_points(df, self.polygon_min_area)


def landcover(df: DataFrame, *, positive: float, negative: float, tolerance: float, area: float, holes: float, smoothing: bool, join: str, by: list[str]) -> DataFrame:
    """Closing and opening by buffers with dissolving in between, simplified, small parts and holes removed."""
    negative = abs(negative)
    step = fe.hash_old_ids(sp.dissolve(cut(fe.explode_and_hash(df.withColumn("geom", g.buffer("geom", positive, join=join)), "landcover"), "grown"), by=by), "landcover")
    opened = g.buffer(g.buffer("geom", -(negative + positive), join=join), negative, join=join)
    step = cut(fe.explode_and_hash(fe.drop_empty(step.withColumn("geom", opened)), "landcover"), "opened")
    step = fe.drop_empty(fe.hash_old_ids(sp.dissolve(step, by=by), "landcover"))
    if tolerance > 0:
        step = step.withColumn("geom", g.with_double("simplifytopology", "geom", tolerance))
    if smoothing:
        step = step.withColumn("geom", g.call("smooth", "geom", F.array().cast("array<binary>"), F.lit(3)))
    step = fe.remove_small_holes(fe.remove_small_polygons(step, area), holes)
    return sp.nearest_z(fe.hash_duplicates(step, "landcover"), df)


class GeneralizeLandcover(Algorithm):
    """A9"""

    accepts: ClassVar = POLYGON
    positive_buffer: float = Field(10.0, ge=0, description="growth that closes gaps")
    negative_buffer: float = Field(-10.0, le=0, description="shrinkage that removes narrow parts")
    simplification_tolerance: float = Field(5.0, ge=0, description="tolerance of the outline")
    area_threshold: float = Field(2500.0, ge=0, description="smaller areas go")
    hole_threshold: float = Field(2500.0, ge=0, description="smaller holes are filled")
    smoothing: bool = Field(False, description="whether corners are cut")
    buffer_join_style: Literal["round", "mitre", "bevel"] = Field("bevel", description="corners of buffers")
    group_by: frozenset[str] = Field(frozenset(), description="columns whose values must agree")

    def _execute(self, df, ref):
        return landcover(df, positive=self.positive_buffer, negative=self.negative_buffer, tolerance=self.simplification_tolerance, area=self.area_threshold, holes=self.hole_threshold, smoothing=self.smoothing, join=self.buffer_join_style, by=sorted(self.group_by))


class GeneralizeConservationAreas(Algorithm):
    """A5"""

    accepts: ClassVar = POLYGON
    references: ClassVar = {"reference_key": Reference(MULTI, True)}
    positive_buffer_coastal_areas: float = Field(25.0, ge=0, description="growth beside water")
    negative_buffer_coastal_areas: float = Field(-5.0, le=0, description="shrinkage beside water")
    positive_buffer_inland_areas: float = Field(5.0, ge=0, description="growth inland")
    negative_buffer_inland_areas: float = Field(-5.0, le=0, description="shrinkage inland")
    simplification_tolerance: float = Field(3.0, ge=0, description="tolerance of the outline")
    area_threshold: float = Field(1000.0, ge=0, description="smaller areas go")
    hole_threshold: float = Field(2000.0, ge=0, description="smaller holes are filled")
    smoothing: bool = Field(False, description="whether corners are cut")
    group_by: frozenset[str] = Field(frozenset(), description="columns whose values must agree")
    reference_key: str = Field("water_areas", description="key of the water areas")

    def _execute(self, df, ref):
        ratio = cut(sp.edge_adjacency(df, ref["reference_key"], 20.0, "_ratio"), "adjacency")
        near_water, other = fe.split_by_ratio(ratio, "_ratio")
        more = {"tolerance": self.simplification_tolerance, "area": self.area_threshold, "holes": self.hole_threshold, "smoothing": self.smoothing, "join": "bevel", "by": sorted(self.group_by)}
        beside = landcover(near_water.drop("_ratio"), positive=self.positive_buffer_coastal_areas, negative=self.negative_buffer_coastal_areas, **more)
        inland = landcover(other.drop("_ratio"), positive=self.positive_buffer_inland_areas, negative=self.negative_buffer_inland_areas, **more)
        both = cut(beside.unionByName(inland), "both")
        return fe.hash_old_ids(sp.dissolve(both, by=sorted(self.group_by)), "landcover")


def urban_areas(df: DataFrame, growth: float, erosion: float, *, join: str = "round") -> DataFrame:
    """Buildings grown, united and eroded again, in single parts (K4)."""
    grown = sp.union_parts(cut(df.withColumn("geom", g.buffer("geom", growth, join=join)), "grown"))
    return fe.drop_empty(sp.explode_parts(fe.drop_empty(grown.withColumn("geom", g.buffer("geom", -erosion, join=join)))))


class GeneralizeBuildingAreas(Algorithm):
    """A2"""

    accepts: ClassVar = POLYGON
    references: ClassVar = {"reference_key_parcels": Reference(POLYGON), "reference_key_roads": Reference(LINE)}
    parcel_coverage_threshold: float = Field(7.5, ge=0, description="per cent of a parcel that is built on")
    parcel_buffer_distance: float = Field(20, gt=0, description="closing between parcels")
    building_size_filter_threshold: float = Field(4000.0, gt=0, description="larger buildings of the classes go")
    building_filter_column: str = Field("building_function_id", description="class column")
    classes_for_filtering: Values = Field(frozenset(), description="classes that are left out if large")
    buildings_simplify_tolerance: float = Field(10.0, ge=0, description="tolerance for buildings")
    boffet_area_buffer: float = Field(10.0, gt=0, description="growth of urban areas")
    boffet_area_erosion: float = Field(10.0, gt=0, description="erosion of urban areas")
    near_area_distance: float = Field(50.0, gt=0, description="what counts as near")
    threshold_building_area_far: float = Field(20000.0, gt=0, description="least area of isolated ones")
    threshold_building_area_near: float = Field(4000.0, gt=0, description="least area near a large one")
    roads_buffer_distance: float = Field(10.0, gt=0, description="room left for roads")
    positive_buffer: float = Field(10.0, ge=0, description="growth that closes gaps")
    negative_buffer: float = Field(-10.0, lt=0, description="shrinkage that removes narrow parts")
    simplification_tolerance: float = Field(4.0, ge=0, description="tolerance of the outline")
    hole_threshold: float = Field(7500, gt=0, description="smaller holes are filled")
    reference_key_parcels: str = Field("parcels", description="key of the parcels")
    reference_key_roads: str = Field("roads", description="key of the roads")

    def _execute(self, df, ref):
        own = fe.exclude_large_of_class(df, self.building_filter_column, self.classes_for_filtering, self.building_size_filter_threshold)
        bare = cut(own.select("fid", "geom", "_ord").withColumn("geom", g.with_double("simplifytopology", "geom", self.buildings_simplify_tolerance)), "buildings")
        areas = urban_areas(bare, self.boffet_area_buffer, self.boffet_area_erosion)
        areas = areas.withColumn("geom", g.with_double("simplifytopology", "geom", 1.0))
        if "reference_key_parcels" in ref:
            built = sp.coverage(ref["reference_key_parcels"].select("fid", "geom", "_ord"), bare, "_c").where(F.col("_c") > self.parcel_coverage_threshold).drop("_c")
            parcels = sp.buffer_and_merge(built, self.parcel_buffer_distance)
            areas = areas.withColumn("_ord", ord_under(0)).unionByName(parcels.withColumn("fid", F.concat(F.lit("parcel:"), "fid")).withColumn("_ord", ord_under(1)))
        areas = sp.union_parts(cut(areas, "areas"))
        areas = cut(areas.withColumn("_ord", F.array(F.monotonically_increasing_id())).withColumn("fid", F.col("_ord")[0].cast("string")), "areas")
        areas = landcover(areas, positive=self.positive_buffer, negative=self.negative_buffer, tolerance=self.simplification_tolerance, area=self.threshold_building_area_near, holes=self.hole_threshold, smoothing=False, join="bevel", by=[])
        if "reference_key_roads" in ref:
            areas = sp.difference(areas, ref["reference_key_roads"].withColumn("geom", g.buffer("geom", self.roads_buffer_distance)))
        areas = cut(sp.explode_parts(sp.union_parts(areas)), "areas")
        near = sp.nearest_other(areas, areas.where(g.area("geom") > self.threshold_building_area_far), self.near_area_distance)
        least = F.when(F.coalesce(F.col("_dist") <= self.near_area_distance, F.lit(False)), F.lit(self.threshold_building_area_near)).otherwise(F.lit(self.threshold_building_area_far))
        kept = near.where(g.area("geom") > least).drop("_dist")
        return fe.hash_geometry(sp.nearest_z(kept, df), "buildingareas")


class GeneralizeBuildings(Algorithm):
    """A3"""

    accepts: ClassVar = frozenset({"Polygon", "Point"})
    area_threshold_for_all_buildings: float = Field(5, gt=0, description="smaller buildings go")
    area_threshold_for_low_priority_buildings: float = Field(100, gt=0, description="smaller ones of low priority go")
    side_threshold: float = Field(30, gt=0, description="buildings with no longer side become points")
    point_size: float = Field(15, gt=0, description="size of a point symbol")
    minimum_distance_to_isolated_building: float = Field(200, gt=0, description="low priority points stay only so far from others")
    hole_threshold: float = Field(75, gt=0, description="smaller holes are filled")
    classes_for_low_priority_buildings: Values = Field(frozenset(), description="classes of low priority")
    classes_for_point_buildings: Values = Field(frozenset(), description="classes that become points")
    classes_for_always_kept_buildings: Values = Field(frozenset(), description="classes that stay")
    building_class_column: str = Field("building_function", description="class column")
    main_angle_column: str = Field("main_angle", description="column of the main angle")

    def _execute(self, df, ref):
        angle = F.when(g.geom_type("geom") == "Point", F.lit(0.0)).otherwise(fe.main_angle())
        own = df if self.main_angle_column in df.columns else df.withColumn(self.main_angle_column, angle)
        c = self.building_class_column
        point = g.geom_type("geom") == "Point"
        polygons = fe.filter_buildings(own.where(~point), c, least=self.area_threshold_for_all_buildings, least_low=self.area_threshold_for_low_priority_buildings, low=self.classes_for_low_priority_buildings, always=self.classes_for_always_kept_buildings)
        touching = polygons.withColumn("geom", g.buffer("geom", 0.1, "flat", "mitre"))
        merged = sp.dissolve(touching, by=[c]).withColumn("geom", g.buffer("geom", -0.1, "flat", "mitre"))
        merged = cut(fe.drop_empty(fe.hash_old_ids(merged, "buildings")), "merged")
        long = F.coalesce(g.call("box", "geom")[1] > self.side_threshold, F.lit(False)) & ~fe.is_in(c, self.classes_for_point_buildings)
        small = merged.where(~long).withColumn("geom", g.centroid("geom")).unionByName(own.where(point))
        return self._points(cut(small, "small")).unionByName(self._large(cut(merged.where(long), "large"), own))

    def _points(self, df: DataFrame) -> DataFrame:
        c = self.building_class_column
        low, always = fe.is_in(c, self.classes_for_low_priority_buildings), fe.is_in(c, self.classes_for_always_kept_buildings)
        first = reduce_by_selecting(df.where(low & ~always), df, self.minimum_distance_to_isolated_building)
        other = reduce_by_selecting(df.where(~low & ~always), None, 1.66 * self.point_size)
        kept = reduce_by_selecting(df.where(always), None, self.point_size)
        return first.unionByName(other).unionByName(kept)

    def _large(self, df: DataFrame, source: DataFrame) -> DataFrame:
        c = self.building_class_column
        simple = lambda d, t: d.withColumn("geom", g.with_double("squared", "geom", t))
        shaped = cut(simple(df, 5), "shaped")
        thin = fe.drop_empty(fe.narrow_parts(shaped, 6)).withColumn("geom", g.buffer("geom", 3, "flat", "mitre")).withColumn("_ord", ord_under(1))
        wide = cut(shaped.withColumn("_ord", ord_under(0)).unionByName(thin), "wide")
        joined = fe.hash_old_ids(sp.dissolve(wide, by=[c]), "buildings")
        gaps = g.buffer(g.buffer("geom", 6, "flat", "mitre"), -6, "flat", "mitre")
        opened = cut(simple(joined, 7.5).withColumn("geom", gaps), "gaps")
        out = simple(fe.hash_old_ids(sp.dissolve(opened, by=[c]), "buildings"), 8)
        out = fe.remove_small_polygons(fe.remove_small_holes(out, self.hole_threshold), self.point_size**2)
        return sp.nearest_z(out, source).select(df.columns)


class GeneralizeWaterAreas(Algorithm):
    """A16"""

    accepts: ClassVar = POLYGON
    references: ClassVar = {"reference_key": Reference(LINE)}
    min_area: float = Field(4000.0, gt=0, description="smaller areas go")
    area_simplification_tolerance: float = Field(10.0, gt=0, description="tolerance of the outline")
    thin_section_width: float = Field(20.0, gt=0, description="narrower sections are widened")
    thin_section_min_size: float = Field(200.0, gt=0, description="least area of such a section")
    thin_section_exaggerate_by: float = Field(3.0, ge=0, description="how much they are widened")
    island_min_area: float = Field(100.0, gt=0, description="smaller islands go")
    island_min_width: float = Field(185.0, gt=0, description="narrower islands are widened")
    island_min_elongation: float = Field(0.25, ge=0, le=1, description="and only so elongated ones")
    island_exaggerate_by: float = Field(3.0, gt=0, description="how much they are widened")
    island_simplification_tolerance: float = Field(10.0, gt=0, description="tolerance for islands")
    smoothing_passes: int = Field(3, ge=0, description="passes of corner cutting")
    preserve_shoreline_sections_column: str | None = Field(None, description="column of shoreline classes")
    preserve_shoreline_sections_values: Values = Field(frozenset(), description="classes that keep their form")
    reference_key: str = Field("shoreline", description="key of the shoreline")
    prefix: ClassVar[str] = "water_areas"

    def _execute(self, df, ref):
        clean = cut(df.withColumn("geom", g.buffer("geom", 0)), "clean")
        segments = fixed = None
        if "reference_key" in ref:
            shore = ref["reference_key"]
            segments = cut(sp.unmatched_segments(clean, shore).select("geom"), "segments")
            fixed = segments
            if self.preserve_shoreline_sections_column:
                fixed = fixed.unionByName(shore.where(fe.is_in(self.preserve_shoreline_sections_column, self.preserve_shoreline_sections_values)).select("geom"))
            at = fixed.select(F.explode(g.vertices("geom")).alias("p")).select(F.col("p")[0].alias("x"), F.col("p")[1].alias("y")).distinct()
            fixed = cut(at.select(g.point(F.col("x"), F.col("y")).alias("geom")), "fixed")
        wide = clean
        if self.thin_section_exaggerate_by > 0:
            thin = sp.explode_parts(fe.drop_empty(fe.narrow_parts(clean, self.thin_section_width))).where(g.area("geom") > self.thin_section_min_size)
            thin = cut(thin.withColumn("geom", g.buffer("geom", self.thin_section_exaggerate_by)), "thin")
            if fixed is not None:  # not where the outline must stay
                thin = sp.semi(thin, fixed, anti=True)
            met = sp.sjoin(clean.select("_ord", "geom"), thin.select("geom")).groupBy(F.col("l._ord").alias("_ord")).agg(F.collect_list("r.geom").alias("_t"))
            wide = clean.join(met, "_ord", "left").withColumn("geom", F.when(F.col("_t").isNull(), F.col("geom")).otherwise(g.union(F.concat(F.array("geom"), "_t")))).select(clean.columns)
        return self._post(cut(self._reshaped(cut(wide, "wide"), fixed), "shaped"), df, ref, segments, fixed)

    def _reshaped(self, df: DataFrame, fixed: DataFrame | None) -> DataFrame:
        """Outlines and islands simplified, each for itself; small ones go and what is left of the islands is cut out.
        An island may lie between several areas, and may have lakes of its own."""
        full = df.withColumn("geom", g.with_double("removeholes", "geom", float("inf")))
        islands = sp.union_parts(df.select("fid", "geom", "_ord")).select("fid", "_ord", F.posexplode(g.call("holes", "geom")).alias("_k", "geom"))
        islands = sp.perforate(cut(islands.select("fid", ord_part("_k").alias("_ord"), "geom"), "islands"), full)
        if self.island_exaggerate_by > 0:
            islands = fe.exaggerate_thin(islands, self.island_min_width, self.island_min_elongation, self.island_exaggerate_by)
        islands = self._simplified(islands, fixed, self.island_simplification_tolerance).where(g.area("geom") > self.island_min_area)
        areas = fe.drop_empty(self._simplified(full, fixed, self.area_simplification_tolerance)).where(g.area("geom") > self.min_area)
        return fe.drop_empty(fe.largest_part(sp.difference(cut(areas, "outlines"), cut(islands, "islands"))))

    @staticmethod
    def _simplified(df: DataFrame, fixed: DataFrame | None, tolerance: float) -> DataFrame:
        none = F.array().cast("array<binary>")
        held = df.withColumn("_masks", none) if fixed is None else sp.masks_of(df, fixed)
        return held.withColumn("geom", g.call("thin", g.call("flat", "geom"), F.coalesce("_masks", none), F.lit(float(tolerance)))).select(df.columns)

    def _post(self, shaped: DataFrame, source: DataFrame, ref: dict[str, DataFrame], segments: DataFrame | None, fixed: DataFrame | None) -> DataFrame:
        out = sp.smooth_keep_topology(shaped, self.smoothing_passes, fixed) if self.smoothing_passes else shaped
        out = cut(out, "smoothed")
        if "reference_key" in ref:
            out = out.withColumn("_ord", ord_under(0)).unionByName(self._shoreline(out, ref["reference_key"], segments).withColumn("_ord", ord_under(1)), allowMissingColumns=True)
        return sp.nearest_z(fe.hash_duplicates(out, self.prefix), source)

    def _shoreline(self, areas: DataFrame, shore: DataFrame, segments: DataFrame) -> DataFrame:
        """Outlines without what was no shoreline before, split where the old shoreline's lines ended, with the
        attributes of the old line that each piece follows (P18)."""
        rims = cut(sp.explode_parts(sp.difference(areas.withColumn("geom", g.boundary("geom")), segments)), "rims")
        pieces = sp.split_lines(rims, shoreline_splitters(shore, rims))
        reach = max(self.thin_section_exaggerate_by, self.island_exaggerate_by) + 1
        return sp.inherit_by_buffer(shore, cut(pieces, "pieces"), distance=reach)


def shoreline_splitters(old: DataFrame, new: DataFrame, most: float = 20.0) -> DataFrame:
    """(geom): a short line across the nearest of the new lines for each end of an old one, no farther than ``most``
    (P17)."""
    ends = old.select(F.explode(g.dump(g.boundary("geom"))).alias("geom")).distinct().withColumn("_ord", F.array(F.monotonically_increasing_id()))
    ends = cut(ends, "ends")
    met = sp.sjoin(ends, new.select("_ord", "geom"), "dwithin", distance=most)
    best = met.groupBy(F.col("l._ord").alias("_ord")).agg(F.min_by(F.struct(F.col("l.geom").alias("p"), F.col("r.geom").alias("g")), F.struct(g.distance("l.geom", "r.geom").alias("d"), F.col("r._ord").alias("o"))).alias("b"))
    return best.select(g.call("crossing", "b.p", "b.g", F.lit(float(most))).alias("geom")).where("geom IS NOT NULL")


class GeneralizeWaterCourseAreas(GeneralizeWaterAreas):
    """A17"""

    line_transform_width: float = Field(30.0, gt=0, description="narrower sections become lines")
    line_min_length: float = Field(200.0, gt=0, description="least length of such a line")
    min_new_section_length: float = Field(300.0, gt=0, description="shorter sections left over become lines too")
    width_check_distance: float = Field(10.0, gt=0, description="how often the width is measured")
    feature_type_column: str = Field("feature_type", description="1 area, 2 line, 3 shoreline")
    thin_section_exaggerate_by: float = Field(0.0, ge=0, description="how much thin sections are widened")
    prefix: ClassVar[str] = "watercourseareas"

    def _post(self, shaped, source, ref, segments, fixed):
        lines, areas = thin_to_lines(shaped, self.line_transform_width, self.line_min_length, self.min_new_section_length, check=self.width_check_distance)
        areas = cut(fe.explode_and_hash(areas, self.prefix), "areas")
        if self.smoothing_passes:
            areas = cut(sp.smooth_keep_topology(areas, self.smoothing_passes, fixed), "areas")
        lines = fe.hash_old_ids(lines, self.prefix)
        t = self.feature_type_column
        out = areas.withColumn(t, F.lit(1)).withColumn("_ord", ord_under(0)).unionByName(lines.withColumn(t, F.lit(2)).withColumn("_ord", ord_under(1)), allowMissingColumns=True)
        if "reference_key" in ref:
            out = out.unionByName(self._shoreline(areas, ref["reference_key"], segments).withColumn(t, F.lit(3)).withColumn("_ord", ord_under(2)), allowMissingColumns=True)
        return sp.nearest_z(fe.hash_duplicates(out, self.prefix), source)


def thin_to_lines(df: DataFrame, width: float, least_line: float, least_section: float, *, check: float = 10.0, step: float = 1.0, old_ids: str = "old_ids") -> tuple[DataFrame, DataFrame]:
    """Centre lines of the sections narrower than ``width`` (measured every ``check`` along the centre line), with the
    attributes of the largest polygon they meet; and the polygons without these sections (P9).

    Polygons that meet are looked at together. A part that is left of a cut polygon stays if its own centre line is
    longer than ``least_section``. The centre line comes from the outline with a vertex every ``step``."""
    grouped = cut(sp.meeting(df), "thin-groups")
    whole = grouped.groupBy("_comp").agg(g.union(F.collect_list("geom")).alias("_u"))
    centre = cut(whole.withColumn("_c", g.with_double("center", "_u", step)), "centre-lines")
    narrow = g.call("narrowplaces", g.with_double("dense", "_c", check), "_u", F.lit(float(width)))
    masks = centre.withColumn("_n", g.with_double("largerthan", narrow, least_line)).where(~g.is_empty("_n")).select("_comp", g.buffer("_n", width, "flat").alias("_m"))
    held = grouped.join(masks, "_comp", "left").withColumn("_d", F.when(F.col("_m").isNotNull(), g.difference("geom", F.array("_m"))))
    changed = F.col("_d").isNotNull() & ~g.call("equal", "geom", "_d")
    rest = held.withColumn("geom", F.when(changed, g.call("longparts", "_d", F.lit(float(least_section)), F.lit(float(step)))).otherwise(F.col("geom")))
    rest = cut(fe.drop_empty(rest.select(*df.columns, "_comp")), "thick")
    left = rest.groupBy("_comp").agg(F.collect_list("geom").alias("_r"))
    over = centre.join(masks.select("_comp"), "_comp").join(left, "_comp", "left")
    new = over.select(F.col("_comp").alias("_ord"), g.difference("_c", F.coalesce("_r", F.array().cast("array<binary>"))).alias("geom")).where(~g.is_empty("geom"))
    lines = cut(sp.explode_parts(new).where(g.geom_type("geom") == "LineString"), "thin-lines")
    return sp.inherit_largest(df, lines, old_ids=old_ids), rest.select(df.columns)
