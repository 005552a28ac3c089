"""Lines beside lines, cell by cell, against plain pairs."""

from pyspark.sql import functions as F

from mapsmith.algorithms import lines
from mapsmith.functions import geometry as g
from mapsmith.operators import spatial as sp


def strokes(spark, n):
    """Lines of one or two segments, some drawn the other way, some in one point."""
    g.install(spark)
    r = lambda k, m: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(m)).cast("double")
    at = lambda dx, dy: F.array(r(1, 20) + dx, r(2, 20) + dy)
    path = F.when(F.col("id") % 3 == 0, F.array(at(0, 0), at(2, r(3, 3)))).when(F.col("id") % 3 == 1, F.array(at(0, 2), at(0, 0), at(3, 0))).otherwise(F.array(at(1, 0), at(0, 0)))
    return spark.range(n).select(F.concat(F.lit("s"), "id").alias("fid"), F.array("id").alias("_ord"), g.line(path).alias("geom")).localCheckpoint()


def test_parallel_segments_are_those_of_all_pairs(spark, monkeypatch):
    df = strokes(spark, 150)
    for full in (128, 3):
        monkeypatch.setattr(sp, "FULL", full)
        seg, met = lines.parallel_segments(df, 1.2, 20.0)
        around = seg.select(F.col("seg").alias("a"), F.col("bearing").alias("ba"), F.col("geom").alias("ga"), g.buffer(g.buffer("geom", 1.2, "flat"), 0.01, "square").alias("u"))
        both = around.crossJoin(seg.select(F.col("seg").alias("b"), F.col("bearing").alias("bb"), F.col("geom").alias("gb")))
        want = both.where(F.abs(F.col("ba") - F.col("bb")) < 20).where(g.call("intersects", "u", "gb") & ~g.call("intersects", "ga", "gb"))
        rows = lambda d: sorted((tuple(r["a"]), tuple(r["b"])) for r in d.select("a", "b").collect())
        assert rows(met) == rows(want) != []
