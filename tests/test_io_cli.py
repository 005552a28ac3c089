import argparse

import pytest
from pyspark.sql import functions as F

from mapsmith import cli
from mapsmith.functions import geometry as g
from mapsmith.operators.model import Features
from mapsmith.sources import geopackage as gp
from tests.test_operators import table


def test_geopackage_round_trip(spark, tmp_path):
    df = table(spark, "POINT (1 2)", "LINESTRING (0 0, 1 1)", n=[1, 2], v=[0.5, 1.5])
    path = str(tmp_path / "x.gpkg")
    gp.write_layer(Features(df), path, "things")
    back = gp.read_layer(spark, path, "things", "fid")
    got = back.df.orderBy("fid").select("fid", "n", "v", g.wkt("geom").alias("w")).collect()
    assert [tuple(r) for r in got] == [("0", 1, 0.5, "POINT (1 2)"), ("1", 2, 1.5, "LINESTRING (0 0, 1 1)")]
    assert back.crs == 3067
    assert gp.read_layer(spark, path).df.count() == 2
    with pytest.raises(FileNotFoundError):
        gp.read_layer(spark, path + "x")


def test_uris():
    assert cli.geopackage_uri("'a.gpkg@b'") == cli.Uri("a.gpkg", "b")
    assert cli.geopackage_uri("a.gpkg|b") == cli.Uri("a.gpkg", "b")
    assert cli.named_uri("masks:a.gpkg") == cli.NamedUri("masks", cli.Uri("a.gpkg"))
    assert len(cli.uris("a.gpkg+b.gpkg@c")) == 2
    for bad in ("a@b@c", "a@b|c"):
        with pytest.raises(argparse.ArgumentTypeError):
            cli.geopackage_uri(bad)
    for bad in (":a", "a", "a:b:c"):
        with pytest.raises(argparse.ArgumentTypeError):
            cli.named_uri(bad)


@pytest.mark.parametrize(("text", "value"), [("100", 100), ("str:100", "100"), ("-10", -10), ("abc", "abc"), ("str:100.0", "str:100.0"), ("1.5", "1.5")])
def test_int_or_str(text, value):
    assert cli.int_or_str(text) == value


def test_commands():
    args = cli.parser().parse_args(["points", "a.gpkg@b", "out.gpkg", "--cluster-distance", "30", "--displace"])
    assert args.cluster_distance == 30.0 and args.displace is True
    args = cli.parser().parse_args(["buildings", "a", "b", "--classes-for-point-buildings", "1", "str:2"])
    assert args.classes_for_point_buildings == [1, "2"]


def test_stream_static(spark, tmp_path):
    from mapsmith.algorithms.lines import GeneralizePoints, GeneralizeSlopeLines
    from mapsmith.streaming.static import generalize_stream

    src = str(tmp_path / "in")
    table(spark, "POINT (0 0)", "POINT (50 50)").write.parquet(src)
    contours = Features(table(spark, "LINESTRING (0 0.5, 9 0.5)"))
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    out = str(tmp_path / "out")
    q = generalize_stream(stream, GeneralizeSlopeLines(), {"contours": contours}, lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r["fid"] for r in spark.read.parquet(out).collect()] == ["0"]
    with pytest.raises(ValueError):
        generalize_stream(stream, GeneralizePoints(), {}, lambda df, n: None, str(tmp_path / "cp2"))
