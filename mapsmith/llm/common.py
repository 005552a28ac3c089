"""What the corpus operators share: table access, cut points in the plan, ASCII text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapsmith.plans import cutting
from mapsmith.plans.cutting import shared_dir as shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: U+0020 and U+0009 to U+000D: what separates words and is stripped from lines.
SPACE = " \t\n\x0b\f\r"


def cut(df: DataFrame, name: str, *, compression: str = "zstd") -> DataFrame:
    return cutting.cut(df, name, compression=compression, counted=False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else unchanged (lower() would also change other letters)."""
    return F.translate(text, UPPER, LOWER)


def least_hashed(rows: DataFrame, n: int, *more: str) -> DataFrame:
    """The ``n`` rows of the least hash of _id (ties by _id, then by ``more``), for a bounded sample.

    What no sample of that size would reach is left out before the sort, so that tasks hand on about 2 n rows in all,
    not n each; should that leave fewer than n, all rows are sorted."""
    many = rows.count()
    if many > 4 * n:
        low = rows.where(F.xxhash64("_id") <= F.lit(2 * n * 2**64 // many - 2**63))
        if low.limit(n).count() == n:
            rows = low
    return rows.orderBy(F.xxhash64("_id"), "_id", *more).limit(n)


def release() -> None:
    """Gives back what earlier stages left in a Python worker that Spark uses again: the tokenizers' word caches, and
    memory that is free but held. Called where a task begins."""
    import ctypes
    import gc
    import sys

    import pyarrow as pa

    if tokens := sys.modules.get("mapsmith.llm.tokens"):
        tokens.forget_all()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)
