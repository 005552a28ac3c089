"""Cut points: a DataFrame written to the shared folder and read back, so that its lineage ends there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What was shuffled for a table is not needed once it stands.
CLEAN_UP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: A table is sent to all tasks by its size as it was counted, not by that of the files that it comes from (rows dealt
#: to cells are many times as large, and would meet in the driver); lists are made of one group at a time, not of all
#: groups of a task at once.
COUNTED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.execution.useObjectHashAggregateExec": "false",
    # few bytes may be much work: what is shuffled goes to all cores
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; in a local session without one (tests), a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="mapsmith-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame, name: str, *, compression: str = "zstd", counted: bool = True) -> DataFrame:
    """``df`` as a table of its own: a lost executor costs no recomputation of what stands before. Unless it is
    ``counted``, joins and lists are planned as the session has it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    how = CLEAN_UP | COUNTED if counted else CLEAN_UP
    before = {key: spark.conf.get(key, None) for key in how}
    try:
        for key, value in how.items():
            spark.conf.set(key, value)
        df.write.option("compression", compression).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Removes the table that ``cut`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        if at.getParent() == jvm.org.apache.hadoop.fs.Path(folder) or at.getParent().toUri().getPath() == jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath():
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
