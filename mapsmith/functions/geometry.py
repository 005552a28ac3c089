"""Geometry functions over WKB columns, as Spark functions named ms_*; also usable in SQL after ``install``."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

JAR = Path(__file__).resolve().parent.parent / "kernel" / "mapsmith-kernels.jar"
_KINDS = {
    "double": "Area Length Distance Project",
    "string": "Type Wkt",
    "boolean": "IsEmpty IsValid Intersects Within Touches Covers",
    "array<double>": "Envelope Box",
    "array<array<double>>": "Vertices",
    "array<binary>": "Dump Holes Faces",
    "binary": "FromWkt Boundary Centroid Inside Hull Fix Flat Reverse Norm Merge Line Union Collect Intersection Difference Shortest RemoveHoles Simplify SimplifyTopology Dense Concave Center Gauss SetZ At Substring Smooth Thin Rectangle Buffer",
}
_EDITS = {
    "double": "MeanDirection CentreLength",
    "boolean": "Equal",
    "array<binary>": "Segments Split SmoothJoints",
    "binary": "Cross MoveTo Largest LargerThan Squared SimplifyKeep AddPoints Snap NarrowPlaces BesideHull Crossing LongParts WithZ",
}
#: Of all rows of a cell and all that may meet them.
_JOINS = {
    "array<int>": "Links Firsts Holders",
    "array<bigint>": "Counts",
    "array<double>": "Common",
    "array<binary>": "Without",
    "array<array<binary>>": "Cuts",
    "array<array<int>>": "Parallels",
    "array<array<string>>": "Names",
}
_installed: set[str] = set()


def install(spark: SparkSession) -> None:
    """Adds the kernels to the session (once); executors fetch the jar from the driver."""
    key = f"{spark.sparkContext.applicationId}:{id(spark._jsparkSession)}"
    if key in _installed or spark.conf.get("spark.mapsmith.kernels", None) == spark.sparkContext.applicationId:
        return
    spark.sql(f"ADD JAR '{JAR}'")
    for owner, kinds in (("Kernels", _KINDS), ("Edits", _EDITS), ("Joins", _JOINS)):
        for kind, names in kinds.items():
            for name in names.split():
                spark.udf.registerJavaFunction(f"ms_{name.lower()}", f"mapsmith.{owner}${name}", kind)
    spark.conf.set("spark.mapsmith.kernels", spark.sparkContext.applicationId)
    _installed.add(key)


def _col(x: object) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def call(name: str, *args: object) -> Column:
    """A string names a column; use lit() for a string value."""
    return F.call_function(f"ms_{name}", *map(_col, args))


def area(g): return call("area", g)  # noqa: E704
def length(g): return call("length", g)  # noqa: E704
def geom_type(g): return call("type", g)  # noqa: E704
def wkt(g): return call("wkt", g)  # noqa: E704
def from_wkt(s): return call("fromwkt", s)  # noqa: E704
def is_empty(g): return call("isempty", g)  # noqa: E704
def distance(a, b): return call("distance", a, b)  # noqa: E704
def dump(g): return call("dump", g)  # noqa: E704
def union(gs): return call("union", gs)  # noqa: E704
def difference(g, gs): return call("difference", g, gs)  # noqa: E704
def intersection(a, b): return call("intersection", a, b)  # noqa: E704
def centroid(g): return call("centroid", g)  # noqa: E704
def boundary(g): return call("boundary", g)  # noqa: E704
def line(points): return call("line", points)  # noqa: E704
def vertices(g): return call("vertices", g)  # noqa: E704


def buffer(g: object, d: object, cap: str = "round", join: str = "round") -> Column:
    return call("buffer", g, F.lit(d).cast("double") if not isinstance(d, Column) else d.cast("double"), F.lit(cap), F.lit(join))


def with_double(name: str, g: object, value: float) -> Column:
    return call(name, g, F.lit(float(value)))


def point(x: Column, y: Column, z: Column | None = None) -> Column:
    """Little-endian WKB of a point, built from its coordinates."""
    return line(F.array(F.array(x.cast("double"), y.cast("double"), *([z.cast("double")] if z is not None else []))))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return call("rectangle", *(c.cast("double") for c in (x0, y0, x1, y1)))


def start_of(g: object) -> Column:
    """First vertex of a line as (x, y, z)."""
    return F.element_at(vertices(g), 1)


def end_of(g: object) -> Column:
    return F.element_at(vertices(g), -1)
