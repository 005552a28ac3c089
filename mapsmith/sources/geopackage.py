"""GeoPackage as a Spark data source: format("geopackage"), options path and layer.

A layer is read as its columns, with the geometry as WKB; partitions are ranges of the row id. The file must be
readable by every executor under the same path (a shared folder). A write makes one file from one task: tables are
coalesced to one partition by ``write_geopackage``, as the format is a single SQLite file.
"""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from mapsmith.operators.model import Features

_TYPES = {"INT": LongType(), "REAL": DoubleType(), "DOUB": DoubleType(), "FLOA": DoubleType(), "BOOL": BooleanType(), "BLOB": BinaryType()}
_ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
ROWS = 50_000
#: Key column of the tables that are written here.
ROW = "_row"


def strip_header(blob: bytes | None) -> bytes | None:
    """WKB of a GeoPackage geometry."""
    if blob is None or blob[:2] != b"GP":
        return blob
    return blob[8 + _ENVELOPE[blob[3] >> 1 & 7] :]


def with_header(wkb: bytes | None, srs: int) -> bytes | None:
    return None if wkb is None else b"GP" + struct.pack("<BBi", 0, 1, srs) + wkb


def layers(path: str) -> dict[str, tuple[str, int]]:
    """Geometry column and coordinate system of each layer."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return {t: (c, s) for t, c, s in db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns")}


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class GeoPackage(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geopackage"

    @property
    def layer(self) -> tuple[str, str]:
        path = self.options["path"]
        return path, self.options.get("layer") or next(iter(layers(path)))

    def schema(self) -> StructType:
        path, layer = self.layer
        geom = layers(path)[layer][0]
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            rows = db.execute(f'PRAGMA table_info("{layer}")').fetchall()
        return StructType([StructField(r[1], BinaryType() if r[1] == geom else _TYPES.get((r[2] or "").upper()[:4], LongType() if "INT" in (r[2] or "").upper() else StringType())) for r in rows])

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(*self.layer, schema)


class Reader(DataSourceReader):
    def __init__(self, path: str, layer: str, schema: StructType):
        self.path, self.layer, self.fields = path, layer, schema
        self.geom = layers(path)[layer][0]

    def partitions(self) -> list[Range]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            first, last = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.layer}"').fetchone()
        if first is None:
            return [Range(0, -1)]
        return [Range(a, min(a + ROWS - 1, last)) for a in range(first, last + 1, ROWS)]

    def read(self, partition: Range) -> Iterator[tuple]:
        names = [f.name for f in self.fields]
        kinds = [f.dataType for f in self.fields]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f'SELECT {", ".join(chr(34) + n + chr(34) for n in names)} FROM "{self.layer}" WHERE rowid BETWEEN ? AND ?', (partition.first, partition.last)):
                yield tuple(strip_header(v) if n == self.geom else bool(v) if isinstance(k, BooleanType) and v is not None else float(v) if isinstance(k, DoubleType) and v is not None else v for n, k, v in zip(names, kinds, row, strict=True))


def read_layer(spark: SparkSession, path: str, layer: str | None = None, unique_id_column: str | None = None) -> Features:
    """A layer as a feature table; without an id column, rows are numbered from 0 in file order (IO1, IO2)."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    spark.dataSource.register(GeoPackage)
    known = layers(path)
    layer = layer or next(iter(known))
    df = spark.read.format("geopackage").option("path", path).option("layer", layer).load()
    geom, srs = known[layer]
    own = next((f for f in df.columns if f in ("fid", "ogc_fid", "id", ROW) and dict(df.dtypes)[f] == "bigint"), None)
    order = F.col(own) if own else F.monotonically_increasing_id()
    df = df.withColumn("_ord", F.array(order.cast("long"))).drop(ROW)  # the key that write_layer makes is no attribute
    if unique_id_column is None:
        return Features(df.withColumn("fid", (F.col("_ord")[0] - (1 if own else 0)).cast("string")), geom, "fid", srs)
    return Features(df.withColumn(unique_id_column, F.col(unique_id_column).cast("string")), geom, unique_id_column, srs)


def write_layer(table: Features, path: str, layer: str) -> None:
    """One layer of a GeoPackage file on the driver's side (IO3). Rows come partition by partition, never all at
    once."""
    df = table.df.drop(table.ord)
    names = {"string": "TEXT", "bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "BOOLEAN", "binary": "BLOB"}
    plain = df.select([F.col(c) if t in names else F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c).cast("string").alias(c) for c, t in df.dtypes])
    srs = table.crs or 0
    with sqlite3.connect(path) as db:
        db.execute("PRAGMA application_id = 1196444487")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT, description TEXT DEFAULT '', last_change DATETIME DEFAULT CURRENT_TIMESTAMP, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL)")
        db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srs}", srs, srs))
        db.execute("DELETE FROM gpkg_contents WHERE table_name = ?", (layer,))
        db.execute("DELETE FROM gpkg_geometry_columns WHERE table_name = ?", (layer,))
        db.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer, layer, srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, ?, 'GEOMETRY', ?, 2, 2)", (layer, table.geom, srs))
        db.execute(f'DROP TABLE IF EXISTS "{layer}"')
        columns = ", ".join(f'"{c}" {names[t]}' for c, t in plain.dtypes)
        db.execute(f'CREATE TABLE "{layer}" ({ROW} INTEGER PRIMARY KEY AUTOINCREMENT, {columns})')
        marks = ", ".join("?" for _ in plain.columns)
        at = plain.columns.index(table.geom)
        for row in plain.toLocalIterator():
            values = [bytes(v) if isinstance(v, bytearray) else v for v in row]
            values[at] = with_header(values[at], srs)
            db.execute(f'INSERT INTO "{layer}" ({", ".join(chr(34) + c + chr(34) for c in plain.columns)}) VALUES ({marks})', values)


def write_parquet(table: Features, path: str) -> None:
    """The sink for large tables: WKB parquet."""
    table.df.write.parquet(path)


def read_parquet(spark: SparkSession, path: str, *, geom: str = "geom", fid: str = "fid", crs: int | None = 3067) -> Features:
    return Features(spark.read.parquet(path), geom, fid, crs)


def difference_report(left: DataFrame, right: DataFrame, path: str) -> None:
    """Rows of either table that the other lacks, as two parquet tables (IO4)."""
    left.exceptAll(right).write.parquet(f"{path}/left_only")
    right.exceptAll(left).write.parquet(f"{path}/right_only")
