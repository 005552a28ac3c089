"""Dissolving large components: members are ranked without shapes, and find their piece by tile."""

from pyspark.sql import functions as F

from mapsmith.functions import geometry as g
from mapsmith.operators import spatial as sp


def chains(spark, n):
    """Squares of 2 in blocks of three that overlap; blocks touch the next in one point."""
    g.install(spark)
    at = spark.range(n).select("id", (F.expr("3 * (id div 3)") + F.expr("0.5D * (id % 3)")).alias("p"))
    low, high = F.col("p"), F.when(F.col("id") % 3 == 2, F.expr("3D * (id div 3) + 3")).otherwise(F.col("p") + 2)
    return at.select(F.format_string("%05d", "id").alias("fid"), F.array("id").alias("_ord"), g.rectangle(low, low, high, high).alias("geom"))


def test_no_shape_is_sorted_with_the_members(spark, monkeypatch):
    """Before, the whole union stood in each member's row while the members were ranked."""
    ranked = []
    monkeypatch.setattr(sp, "cut", lambda df, name, f=sp.cut: (ranked.append(df), f(df, name))[1])
    out = sp.dissolve(chains(spark, 30))
    for df in [*ranked, out]:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan or "binary" not in {t for _, t in df.dtypes}, plan


def test_members_find_their_piece_by_tile(spark, monkeypatch):
    """One component by single points, of 100 pieces that lie in many tiles."""
    monkeypatch.setattr(sp, "AT_ONCE", 8)
    out = sp.dissolve(chains(spark, 300)).select("fid", "old_ids", F.round(g.area("geom"), 6).alias("a")).collect()
    assert len(out) == 100
    for r in out:
        k = int(r["fid"])
        assert sorted(r["old_ids"]) == [f"{i:05d}" for i in range(k - k % 3, k - k % 3 + 3)]
    assert sum(len(r["old_ids"]) for r in out) == 300


def test_union_of_lines_grows_with_their_number(spark):
    """40,000 lines beside each other; before, each was compared with all of them."""
    import time

    g.install(spark)
    y = F.col("id") / 1000
    rows = lambda n: spark.range(n).select(g.line(F.array(F.array(F.lit(0.0), y), F.array(F.lit(9.0), y))).alias("geom"))
    rows(10).select(g.length("geom")).collect()
    began = time.time()
    assert rows(40_000).agg(g.length(g.union(F.collect_list("geom"))).alias("n")).head()[0] == 360_000
    assert time.time() - began < 15
