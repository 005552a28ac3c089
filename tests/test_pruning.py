from pyspark.sql import functions as F

from mapsmith.operators import network as nw


def test_a_tail_of_any_length_is_pruned(spark, monkeypatch):
    """54 tracks in a row behind a free one: each round takes one off the end."""

    def in_a_row(lines, others):
        last = F.array(F.lit(lines.agg(F.max("_ord")).head()[0][0]).cast("long"))
        return lines.withColumns({"first_intersects": F.lit(True), "last_intersects": F.col("_ord") < last})

    monkeypatch.setattr(nw, "end_touches", in_a_row)
    rows = [(f"t{i}", [i], "cluster_track" if i else "free_track") for i in range(55)]
    tracks = spark.createDataFrame(rows, "fid string, _ord array<long>, kind string")
    assert [r["fid"] for r in nw.prune_to_fixpoint(tracks, "kind", "cluster_track").collect()] == ["t0"]
