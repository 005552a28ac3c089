"""Cut points: how a table is planned, and what is sent to all tasks."""

from pyspark.sql import functions as F

from mapsmith.functions import geometry as g
from mapsmith.operators import spatial as sp
from mapsmith.plans.cutting import cut


def test_dealt_rows_are_not_sent_to_all_tasks(spark):
    """Before, a table was broadcast by the size of its file, however many cells its rows were dealt to."""
    g.install(spark)
    at = (7 * F.col("id") % 90).cast("double")
    r = spark.range(50).select(F.array("id").alias("_ord"), g.rectangle(at, at, at + 9, at + 9).alias("geom"))
    small = cut(r, "small")
    for df in (sp.pairs(small, small), sp.met_by(small, small)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_cut_leaves_the_session_as_it_was(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.execution.useObjectHashAggregateExec", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in keys]
    cut(spark.range(3), "three")
    assert [spark.conf.get(k, None) for k in keys] == before
