"""Feature tables, geometry types, coordinate systems and errors."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapsmith.functions import geometry as g


class GeometryTypeError(Exception): ...


class GeometryOperationError(Exception): ...


class InvalidGeometryError(Exception): ...


class GeoCombineError(Exception): ...


class InvalidCRSError(Exception): ...


class MissingReferenceError(Exception):
    def __init__(self, message: str = "Reference data is missing."):
        super().__init__(message)


def ord_under(first: int, order: Column | str = "_ord") -> Column:
    """The order of a table that stands ``first``-th among those it is united with."""
    return F.concat(F.array(F.lit(first).cast("long")), F.col(order) if isinstance(order, str) else order)


def ord_part(k: Column | str, order: Column | str = "_ord") -> Column:
    """The order of the ``k``-th part of a row: after the row's own, before the next row's."""
    return F.concat(F.col(order) if isinstance(order, str) else order, F.array((F.col(k) if isinstance(k, str) else k).cast("long")))


GEOMETRY_TYPES = frozenset("Point LineString LinearRing Polygon MultiPoint MultiLineString MultiPolygon GeometryCollection".split())
#: Known systems; others count as projected if listed by the caller.
PROJECTED, GEOGRAPHIC = frozenset({3067, 3857, 3903, 3879, 25832, 25833, 32634, 32635}), frozenset({4326, 4258})


@dataclass(frozen=True)
class Features:
    """A table with one geometry column (WKB), a string id and a row order (``ord``: what "first" means, a list of
    numbers compared from the left; parts of a row and appended tables get further or leading numbers, so that orders
    neither overflow nor meet). A single number is taken as a list of one."""

    df: DataFrame
    geom: str = "geom"
    fid: str = "fid"
    crs: int | None = 3067
    ord: str = "_ord"

    def __post_init__(self) -> None:
        g.install(self.df.sparkSession)
        df = self.df
        if dict(df.dtypes)[self.fid] != "string":
            df = df.withColumn(self.fid, F.col(self.fid).cast("string"))
        if self.ord not in df.columns:
            df = df.withColumn(self.ord, F.array(F.monotonically_increasing_id()))
        elif not isinstance(df.schema[self.ord].dataType, T.ArrayType):
            df = df.withColumn(self.ord, F.array(F.col(self.ord).cast("long")))
        object.__setattr__(self, "df", df)

    def plain(self) -> DataFrame:
        """With columns geom, fid and _ord whatever they are called here."""
        names = {self.geom: "geom", self.fid: "fid", self.ord: "_ord"}
        return self.df.select([F.col(c).alias(names.get(c, c)) for c in self.df.columns])

    def of(self, df: DataFrame) -> Features:
        """``df`` has the plain names; it gets this table's."""
        names = {"geom": self.geom, "fid": self.fid, "_ord": self.ord}
        return replace(self, df=df.select([F.col(c).alias(names.get(c, c)) for c in df.columns]))


def parse_type(name: str) -> str:
    if name not in GEOMETRY_TYPES:
        raise ValueError(f"not a geometry type: {name}")
    return name


def wrong_types(df: DataFrame, accepted: set[str] | frozenset[str], geom: str = "geom") -> DataFrame:
    """Rows whose type is not accepted; null counts as wrong (F1)."""
    return df.where(F.col(geom).isNull() | ~g.geom_type(geom).isin(*accepted))


def check_types(df: DataFrame, accepted: set[str] | frozenset[str], geom: str = "geom") -> bool:
    return wrong_types(df, accepted, geom).isEmpty()


def check_projected(crs: int | None) -> None:
    if crs is None:
        raise InvalidCRSError("the table has no coordinate system")
    if crs in GEOGRAPHIC:
        raise InvalidCRSError(f"EPSG:{crs} is not projected")


def combine(tables: list[Features]) -> Features:
    """UNION ALL by name of tables of one coordinate system and geometry column (IO10)."""
    if not tables:
        raise GeoCombineError("nothing to combine")
    if not all(isinstance(t, Features) for t in tables):
        raise GeoCombineError("not a feature table")
    if len({t.crs for t in tables}) > 1:
        raise GeoCombineError("different coordinate systems")
    if len({t.geom for t in tables}) > 1:
        raise GeoCombineError("different geometry columns")
    if len(tables) == 1:
        return tables[0]
    # tables keep their order, and rows theirs within a table
    out = tables[0].df.withColumn(tables[0].ord, ord_under(0, tables[0].ord))
    for k, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.df.withColumnRenamed(t.ord, tables[0].ord).withColumn(tables[0].ord, ord_under(k, tables[0].ord)), allowMissingColumns=True)
    return replace(tables[0], df=out)


FAMILIES = {"polygon": {"Polygon", "MultiPolygon"}, "line": {"LineString", "MultiLineString", "LinearRing"}, "point": {"Point", "MultiPoint"}}


def group_by_family(tables: list[Features]) -> dict[str, Features | None]:
    """Whole tables by family; mixed ones are dropped, empty ones go to the first family (IO11)."""
    held: dict[str, list[Features]] = {k: [] for k in FAMILIES}
    for t in tables:
        types = {r[0] for r in t.df.select(g.geom_type(t.geom)).distinct().collect()}  # eight at most
        for family, members in FAMILIES.items():
            if types <= members:
                held[family].append(t)
                break
    return {k: combine(v) if v else None for k, v in held.items()}


def empty_like(df: DataFrame, extra: dict[str | None, str] | None = None) -> DataFrame:
    """Same schema and no rows, with further typed columns; a None name is skipped."""
    return add_columns(df.limit(0), extra or {})


def add_columns(df: DataFrame, columns: dict[str | None, str]) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n is not None}) if columns else df
