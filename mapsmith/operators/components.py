"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mapsmith.plans.cutting import cut, drop_cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # aggregated in each task first and joined, as a node may have edges to a third of all nodes
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v")))


#: Up to so many edges are walked at once.
FEW_EDGES = 20_000


def _walked(pairs: DataFrame) -> DataFrame:
    """The components of few edges, without rounds."""
    up: dict = {}
    hashable = lambda n: tuple(n) if isinstance(n, list) else n

    def root(n):
        while up[n] != n:
            up[n] = n = up[up[n]]
        return n

    for a, b in pairs.collect():  # FEW_EDGES at most
        a, b = hashable(a), hashable(b)
        up.setdefault(a, a)
        up.setdefault(b, b)
        low, high = sorted((root(a), root(b)))
        up[high] = low
    kind = pairs.schema["u"].dataType
    plain = list if isinstance(kind, T.ArrayType) else lambda n: n
    rows = {"node": [plain(n) for n in up], "component": [plain(root(n)) for n in up]}
    schema = T.StructType([T.StructField("node", kind), T.StructField("component", kind)])
    return pairs.sparkSession.createDataFrame(pa.table(rows, to_arrow_schema(schema)))  # no Python worker reads it


def components(edges: DataFrame, src: str = "src", dst: str = "dst", *, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another; component is its least reachable node.

    Nodes are whole numbers, or of any type with an order (then they are numbered in that order first, so that the
    rounds move numbers). Few edges between numbers, texts or lists of numbers are walked in the driver. Loops, repeated and reversed edges are allowed. Every round is written to the shared folder
    and the one before it removed."""
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u != v").distinct()
    kind = pairs.schema["u"].dataType
    pairs = cut(pairs, "edges")
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
    if isinstance(inner, T.IntegralType | T.StringType) and pairs.count() <= FEW_EDGES:
        return _walked(pairs)
    if isinstance(kind, T.IntegralType):
        return _rounds(pairs, max_rounds)
    names = pairs.select(F.col("u").alias("name")).unionByName(pairs.select(F.col("v").alias("name"))).distinct()
    numbers = cut(names.orderBy("name").withColumn("n", F.monotonically_increasing_id()), "nodes")  # increase with the order
    u, v = numbers.select(F.col("name").alias("u"), F.col("n").alias("un")), numbers.select(F.col("name").alias("v"), F.col("n").alias("vn"))
    found = _rounds(cut(pairs.join(u, "u").join(v, "v").select(F.col("un").alias("u"), F.col("vn").alias("v")), "edges"), max_rounds)
    named = found.join(numbers.select(F.col("n").alias("node"), F.col("name").alias("_node")), "node").join(numbers.select(F.col("n").alias("component"), F.col("name").alias("_component")), "component")
    return named.select(F.col("_node").alias("node"), F.col("_component").alias("component"))


def _rounds(now: DataFrame, max_rounds: int) -> DataFrame:
    seen = None
    for _ in range(max_rounds):
        before, now = now, cut(_small_star(_large_star(now).distinct()).distinct(), "edges")
        drop_cut(before)
        print_of = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).head())
        if print_of == seen:
            break
        seen = print_of
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
