"""Filters, identity and small per-row operators of feature tables (columns fid, geom, _ord and attributes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapsmith.functions import geometry as g
from mapsmith.operators.model import GeometryTypeError, check_types, ord_part
from mapsmith.operators.spatial import explode_parts, masks_of

AREAS, LINES = {"Polygon", "MultiPolygon"}, {"LineString", "MultiLineString", "LinearRing"}


def drop_empty(df: DataFrame) -> DataFrame:
    """F6"""
    return df.where(F.col("geom").isNotNull() & ~g.is_empty("geom"))


def fix_invalid(df: DataFrame) -> DataFrame:
    """F7"""
    return df.withColumn("geom", F.when(g.call("isvalid", "geom"), F.col("geom")).otherwise(g.call("fix", "geom")))


def remove_large_polygons(df: DataFrame, area: float) -> DataFrame:
    """F3"""
    return df.where(g.area("geom") <= area)


def remove_small_polygons(df: DataFrame, area: float) -> DataFrame:
    """F4"""
    return drop_empty(df).where(g.area("geom") >= area)


def remove_short_lines(df: DataFrame, length: float, *, strict: bool = False) -> DataFrame:
    """F5; ``strict`` looks at the types first (one job)."""
    if strict and not check_types(df, LINES):
        raise GeometryTypeError("only lines are accepted")
    return df.where(g.length("geom") >= length)


def remove_small_holes(df: DataFrame, area: float) -> DataFrame:
    """F8"""
    return df.withColumn("geom", g.with_double("removeholes", "geom", area))


def is_in(column: str, values: frozenset | set | list) -> Column:
    """False for null and for an empty set."""
    return F.coalesce(F.col(column).cast("string").isin([str(v) for v in values]), F.lit(False)) if values else F.lit(False)


def filter_buildings(df: DataFrame, column: str, *, least: float, least_low: float, low: frozenset, always: frozenset) -> DataFrame:
    """F9"""
    a = g.area("geom")
    return df.where(((a >= least) & ~(is_in(column, low) & (a < least_low))) | is_in(column, always))


def exclude_large_of_class(df: DataFrame, column: str, classes: frozenset, area: float) -> DataFrame:
    """F10; a null class stays."""
    return df.where(~(is_in(column, classes) & (g.area("geom") > area)))


def by_interval(df: DataFrame, column: str, interval: float) -> DataFrame:
    """F11"""
    return df.where(F.pmod(F.col(column).cast("double"), F.lit(float(interval))) == 0)


def by_box_side(df: DataFrame, side: float) -> tuple[DataFrame, DataFrame]:
    """Polygons whose least rectangle is longer than ``side``, and the others."""
    longest = g.call("box", "geom")[1]
    return df.where(longest > side), df.where(~F.coalesce(longest > side, F.lit(False)))


def main_angle(geom: str = "geom") -> Column:
    """Degrees from north of the longer side of the least rectangle, 0 to 180."""
    return g.call("box", geom)[2]


def elongation(geom: str = "geom") -> Column:
    """Width over height of the least rectangle, 1 at most."""
    return F.try_divide(g.call("box", geom)[0], g.call("box", geom)[1])


def exaggerate_thin(df: DataFrame, width: float, elongated: float, by: float, *, cap: str = "round", join: str = "round") -> DataFrame:
    """P6"""
    thin = (elongation() <= elongated) & (g.call("box", "geom")[0] <= width)
    return df.withColumn("geom", F.when(thin, g.buffer("geom", by, cap, join)).otherwise(F.col("geom")))


def split_by_ratio(df: DataFrame, column: str, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Rows above ``share``, and the others; null is not above."""
    above = F.coalesce(F.col(column) > share, F.lit(False))
    return df.where(above), df.where(~above)


def interior_rings(df: DataFrame) -> DataFrame:
    """A row for each hole, as a polygon; ids repeat."""
    out = df.select(*[c for c in df.columns if c != "geom"], F.posexplode(g.call("holes", "geom")).alias("_k", "geom"))
    return out.withColumn("_ord", ord_part("_k")).select(df.columns)


def moved_to(geom: str, x: Column, y: Column) -> Column:
    """Translated so that the centroid is at (x, y)."""
    return g.call("moveto", geom, x, y)


def split_at(line: str, distances: list[float]) -> Column:
    """Pieces of a line between distinct distances along it; 0, its length and what is beyond are no cuts."""
    n = g.length(line)
    inner = F.filter(F.array_sort(F.array_distinct(F.array(*(F.lit(float(d)) for d in distances)))), lambda d: (d > 0) & (d < n))
    bounds = F.concat(F.array(F.lit(0.0)), inner, F.array(n))
    return F.transform(F.sequence(F.lit(1), F.size(bounds) - 1), lambda i: g.call("substring", line, F.element_at(bounds, i), F.element_at(bounds, i + 1)))


def without_members(df: DataFrame, grouped: DataFrame, column: str = "old_ids") -> DataFrame:
    """Rows whose id is in no list of ``grouped``."""
    return by_ids(df, grouped.select(F.explode(column).alias("fid")), anti=True)


def by_ids(df: DataFrame, others: DataFrame, *, anti: bool = False) -> DataFrame:
    """Rows whose id is (``anti``: is not) among those of ``others``."""
    return df.join(others.select("fid").distinct(), "fid", "left_anti" if anti else "left_semi").select(df.columns)


def prune_network(df: DataFrame, longest: float, *, length: str, dead: str, apart: str) -> DataFrame:
    """Rows of dead ends and of disconnected lines go unless they are longer."""
    return df.where(~((F.col(length) <= longest) & (F.col(dead) | F.col(apart))))


def only(df: DataFrame, columns: list[str]) -> DataFrame:
    """Without the columns that were added on the way (F16)."""
    return df.select([c for c in df.columns if c in columns])


def hash_geometry(df: DataFrame, prefix: str) -> DataFrame:
    """Ids from the geometry's text."""
    return df.withColumn("fid", F.sha2(F.concat(F.lit(prefix), g.wkt("geom")), 256))


def hashed_id(prefix: str) -> Column:
    return F.sha2(F.concat(F.lit(prefix), "fid", g.wkt("geom")), 256)


def hash_duplicates(df: DataFrame, prefix: str) -> DataFrame:
    """Every member of a set of equal ids gets a new one from id and geometry."""
    many = F.count("*").over(Window.partitionBy("fid")) > 1
    return df.withColumn("fid", F.when(many, hashed_id(prefix)).otherwise(F.col("fid")))


def hash_old_ids(df: DataFrame, prefix: str, column: str = "old_ids", *, drop: bool = True) -> DataFrame:
    """Ids from the sorted ids of two source rows or more."""
    if not dict(df.dtypes)[column].startswith("array"):
        raise TypeError(f"{column} must hold lists")
    new = F.sha2(F.concat(F.lit(prefix), F.array_join(F.array_sort(column), "")), 256)
    out = df.withColumn("fid", F.when(F.size(column) > 1, new).otherwise(F.col("fid")))
    return out.drop(column) if drop else out


def explode_and_hash(df: DataFrame, prefix: str) -> DataFrame:
    """I4"""
    return hash_duplicates(explode_parts(df), prefix)


def random_ids(df: DataFrame) -> DataFrame:
    """I5"""
    return df.withColumn("fid", F.sha2(F.expr("uuid()"), 256))


def z_from_attribute(df: DataFrame, column: str) -> DataFrame:
    """S20"""
    return df.withColumn("geom", g.call("setz", "geom", F.col(column).cast("double")))


def polygons_to_points(df: DataFrame, least: float) -> DataFrame:
    """Polygons below ``least`` become a point within, with their mean z."""
    v = g.vertices("geom")
    zs = F.filter(F.transform(v, lambda p: p[2]), lambda z: ~F.isnan(z) & (z != -999.999))
    z = F.when(F.size(zs) > 0, F.aggregate(zs, F.lit(0.0), lambda s, x: s + x) / F.size(zs))
    inside = F.when(z.isNull(), g.call("inside", "geom")).otherwise(g.call("setz", g.call("inside", "geom"), z))
    return df.withColumn("geom", F.when(g.area("geom") >= least, F.col("geom")).otherwise(inside))


def narrow_parts(df: DataFrame, width: float) -> DataFrame:
    """What an opening by half of ``width`` takes away, but for slivers: a row for each row, empty if there is
    nothing (P5)."""
    clean = df.withColumn("geom", g.buffer("geom", 0))
    opened = lambda c, d: g.buffer(g.buffer(c, -d, "flat", "mitre"), d, "flat", "mitre")
    wide = clean.withColumn("geom", opened("geom", width / 2)).where(~g.is_empty("geom"))
    out = masks_of(clean, wide)
    rest = F.when(F.col("_masks").isNull(), F.col("geom")).otherwise(g.difference("geom", "_masks"))
    return out.withColumn("geom", opened(rest, 0.1)).select(df.columns)


def largest_part(df: DataFrame) -> DataFrame:
    """The largest part of each polygon or line."""
    return df.withColumn("geom", g.call("largest", "geom"))


def remove_small_parts(df: DataFrame, least: float) -> DataFrame:
    """Parts larger than ``least``; a row without any becomes empty."""
    return df.withColumn("geom", g.with_double("largerthan", "geom", least))
