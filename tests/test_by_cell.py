"""Joins by cell against plain pairs, on shapes of all sizes and kinds."""

import pytest
from pyspark.sql import functions as F

from mapsmith.algorithms import areas
from mapsmith.functions import geometry as g
from mapsmith.operators import spatial as sp
from mapsmith.operators.model import Features


def shapes(spark, n, seed, wide=0):
    """Rectangles, triangles, points and empty or missing shapes; every ``wide``-th is a hundred times as wide."""
    g.install(spark)
    r = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(64))
    df = spark.range(n).select("id", r(0).alias("x"), r(1).alias("y"), (r(2) % 9 + 1).alias("w"), (r(3) % 9 + 1).alias("h"))
    if wide:
        df = df.withColumn("w", F.when(F.col("id") % wide == 0, F.col("w") * 100).otherwise(F.col("w")))
    x0, y0, x1, y1 = F.col("x"), F.col("y"), F.expr("x + w"), F.expr("y + h")
    at = lambda *v: F.concat_ws(" ", *(c.cast("string") for c in v))
    triangle = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", at(x0, y0), at(x1, y0), at(x0, y1), at(x0, y0)), F.lit("))"))
    geom = F.when(F.col("id") % 7 == 3, g.from_wkt(triangle)).when(F.col("id") % 11 == 5, g.from_wkt(F.lit("POLYGON EMPTY"))).when(F.col("id") % 13 == 6, F.lit(None)).otherwise(g.rectangle(x0, y0, x1, y1))
    return df.select(F.concat(F.lit("s"), F.col("id") % (n // 2)).alias("fid"), F.array("id").alias("_ord"), geom.alias("geom")).localCheckpoint()


@pytest.fixture(scope="module", params=[0, 17])
def tables(spark, request):
    return shapes(spark, 240, 1, request.param), shapes(spark, 160, 2, 23)


def rows(df):
    return sorted(map(str, df.collect()))


def test_pieces_are_those_of_all_pairs(tables):
    left, right = tables
    met = sp.sjoin(left, right.select("geom")).withColumn("_g", g.intersection("l.geom", "r.geom")).where(~g.is_empty("_g"))
    plain = met.select("l.fid", F.col("l._ord").alias("_ord"), g.wkt("_g").alias("w"))
    assert rows(sp.intersection(left, right).select("fid", "_ord", g.wkt("geom").alias("w"))) == rows(plain)


def test_what_is_left_is_what_the_union_of_masks_leaves(tables):
    left, right = tables
    plain = sp.masks_of(left, right).withColumn("geom", F.when(F.col("_masks").isNull(), F.col("geom")).otherwise(g.difference("geom", "_masks"))).where(~g.is_empty("geom"))
    tell = lambda d: rows(d.select("_ord", g.wkt(g.call("norm", "geom")).alias("w")))
    assert tell(sp.difference(left, right)) == tell(plain)


def test_sums_counts_and_firsts(tables):
    left, right = tables
    met = sp.sjoin(left.select("_ord", "geom"), right)
    by = met.groupBy(F.col("l._ord").alias("_ord"))
    assert rows(sp.overlap_areas(left, right, "a").select("_ord", F.round("a", 6))) == rows(by.agg(F.round(F.sum(g.area(g.intersection("l.geom", "r.geom"))), 6).alias("round(a, 6)")))
    assert rows(sp.semi(left, right).select("_ord")) == rows(by.count().select("_ord"))
    assert sp.semi(left, right).count() + sp.semi(left, right, anti=True).count() == left.count()
    first = by.agg(F.min_by("r.fid", "r._ord").alias("f"), F.count("*").alias("n"))
    out = sp.inherit_first(right, left).join(first, "_ord")
    assert out.count() == first.count() and out.where("fid IS NULL").isEmpty()
    largest = by.agg(F.array_sort(F.collect_list(F.struct((-g.area("r.geom")).alias("s"), "r._ord", "r.fid"))).alias("a"))
    assert rows(sp.inherit_largest(right, left, old_ids="ids").select("_ord", "fid", "ids")) == rows(largest.select("_ord", F.col("a.fid")[0].alias("fid"), F.col("a.fid").alias("ids")))


def test_links_are_few_and_make_the_same_components(tables):
    for df in tables:
        met = sp.sjoin(df, df).where("l._ord < r._ord").select(F.col("l._ord").alias("a"), F.col("r._ord").alias("b"))
        assert rows(sp.labels(df, sp.touching(df)).select("_ord", "_comp")) == rows(sp.labels(df, met).select("_ord", "_comp"))


def test_rows_on_one_spot_give_a_link_each_not_all_pairs(spark):
    """1,000 rows that all meet: before, half a million links."""
    g.install(spark)
    one = spark.range(1000).select(F.array("id").alias("_ord"), g.rectangle(F.lit(0), F.lit(0), F.col("id") % 3 + 1, F.lit(1)).alias("geom"))
    assert sp.touching(one).count() <= 4000


def test_pairs_are_never_shuffled(spark, tables):
    """Each kind of join hands on rows and candidates, so no plan joins row with row and groups the pairs."""
    left, right = tables
    for df in (sp.intersection(left, right), sp.difference(left, right), sp.overlap_areas(left, right, "a"), sp.inherit_largest(right, left, old_ids="i")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "collect_list" in plan


def test_ids_of_pieces_are_counted_before_pieces_are_made(tables):
    """Ids that come more than once, by pieces or by rows, are hashed as before."""
    from mapsmith.operators import features as fe

    left, right = (Features(t.where(g.geom_type("geom") == "Polygon").where(~g.is_empty("geom"))) for t in tables)
    plain = fe.explode_and_hash(sp.intersection(left.df, right.df), "keepintersection")
    out = areas.KeepIntersection().execute(left, {"mask": right}).df
    assert rows(out.select("fid", "_ord", g.wkt("geom").alias("w"))) == rows(plain.select("fid", "_ord", g.wkt("geom").alias("w")))


def test_rectangles_are_built_and_measured_without_text(spark):
    """Before, the views wrote each rectangle as text and parsed it again, every time that a table was read."""
    g.install(spark)
    at = spark.range(50).select(*[((F.col("id") * k) % 13 - 6.25).alias(f"c{k}") for k in (3, 5)], *[(F.col("id") * k % 11 + 0.1).alias(f"d{k}") for k in (2, 7)])
    x0, y0, x1, y1 = F.col("c3"), F.col("c5"), F.expr("c3 + d2"), F.expr("c5 + d7")
    text = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *(F.concat_ws(" ", a.cast("string"), b.cast("string")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)))), F.lit("))"))
    df = at.select(g.rectangle(x0, y0, x1, y1).alias("r"), g.from_wkt(text).alias("t"))
    assert "fromwkt" not in at.select(g.rectangle(x0, y0, x1, y1))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert df.where("r != t").isEmpty()
    same = g.call("reverse", "r")  # is read as a shape by its other measures, and has the same bounds
    assert df.where((g.area("r") != g.area(g.call("norm", same))) | (g.geom_type("r") != "Polygon") | g.is_empty("r") | (g.call("envelope", "r") != F.array(x0, y0, x1, y1))).isEmpty()
