"""Feature tables over the driver's tables, in integer arithmetic, as Spark SQL and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapsmith.functions import geometry as g

X, Y = "(37 * {k} * {k} + 11 * {k}) % 1009", "(53 * {k} * {k} + 29 * {k} + 7) % 1013"


def _xy(k: str) -> tuple[str, str]:
    return X.format(k=k), Y.format(k=k)


_px, _py = _xy("c_custkey")
_rx, _ry = _xy("p_partkey")
_mx, _my = _xy("s_suppkey")
#: Of each view its columns over a table; // is integer division in DuckDB and div in Spark.
VIEWS = {
    "pts": ("customer", f"CAST(c_custkey AS {{s}}) fid, c_custkey k, {_px} x, {_py} y, c_mktsegment cls, c_acctbal v", ""),
    "rects": ("part", f"CAST(p_partkey AS {{s}}) fid, p_partkey k, {_rx} x0, {_ry} y0, {_rx} + p_size x1, {_ry} + 1 + p_partkey % 20 y1, p_brand cls", ""),
    "masks": ("supplier", f"CAST(s_suppkey AS {{s}}) fid, s_suppkey k, {_mx} x0, {_my} y0, {_mx} + 40 x1, {_my} + 30 y1", ""),
    "edges_right": ("orders", "CAST(o_orderkey * 2 AS {s}) fid, o_orderkey * 2 k, o_orderkey % 61 ax, o_orderkey {d} 61 ay, o_orderkey % 61 + 1 bx, o_orderkey {d} 61 by_, o_orderpriority cls", "(7 * o_orderkey * o_orderkey + o_orderkey) % 10 < 5"),
    "edges_up": ("orders", "CAST(o_orderkey * 2 + 1 AS {s}) fid, o_orderkey * 2 + 1 k, o_orderkey % 61 ax, o_orderkey {d} 61 ay, o_orderkey % 61 bx, o_orderkey {d} 61 + 1 by_, o_orderpriority cls", "(3 * o_orderkey * o_orderkey + o_orderkey) % 7 < 4"),
}


def _select(name: str, kind: str, div: str) -> str:
    table, columns, where = VIEWS[name]
    return f"SELECT {columns.format(s=kind, d=div)} FROM {table}" + (f" WHERE {where}" if where else "")


def duck(*names: str) -> str:
    """WITH clause of the views, for an oracle."""
    parts = []
    for n in names:
        parts.append(f"{n} AS (SELECT * FROM edges_right UNION ALL SELECT * FROM edges_up)" if n == "edges" else f"{n} AS ({_select(n, 'VARCHAR', '//')})")
    if "edges" in names:
        parts = [f"{n} AS ({_select(n, 'VARCHAR', '//')})" for n in ("edges_right", "edges_up")] + parts
    return ", ".join(parts)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Attributes of a view, without a geometry."""
    if name == "edges":
        return view(spark, sf_dir, "edges_right").unionByName(view(spark, sf_dir, "edges_up"))
    table, columns, where = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    df = df.where(where) if where else df
    return df.selectExpr(*[_aliased(c) for c in _columns(columns.format(s="STRING", d="div"))])


def spread(df: DataFrame, key: str = "k") -> DataFrame:
    """Rows of a small file dealt to all cores, as shapes are more work than bytes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def _columns(text: str) -> list[str]:
    return text.split(", ")


def _aliased(column: str) -> str:
    expression, _, name = column.rpartition(" ")
    return f"{expression} AS {name}" if expression else column


def features(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view with geom and _ord (its key)."""
    g.install(spark)
    df = spread(view(spark, sf_dir, name)).withColumn("_ord", F.array(F.col("k").cast("long")))
    if name == "pts":
        return df.withColumn("geom", g.point(F.col("x"), F.col("y")))
    if name.startswith("edges"):
        at = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
        return df.withColumn("geom", g.line(F.array(at("ax", "ay"), at("bx", "by_"))))
    return df.withColumn("geom", g.rectangle(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
