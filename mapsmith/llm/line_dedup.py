"""Line dedup: range-partitioned line hashes, sorted by document and position; first occurrences are streamed and
what comes back per document is a run-length bitmap of dropped lines, not text.

Results in special cases: a null or empty text is one empty line, which is always kept; a row with a null id takes
no part and keeps all lines; rows that repeat an id are one document (none of its lines is dropped for another of
its rows); further columns are carried by ``apply_bitmaps`` and never looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapsmith.llm.common import SPACE, ascii_lower, cut

#: A hash is split by document into at least so many parts, so that a line held by a third of all documents is still
#: dealt to several tasks; the first of each part meet in a second pass of at most that many documents a line. With the
#: lines' number their root grows, so that neither pass gets a line as a whole.
SALTS, LINES_A_SALT = 32, 64


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(_id, _th, _pos, _h1, _h2) of each line whose key has ``min_chars`` code points; _th tells apart rows that
    share an id, _h1 and _h2 are 128 bits of the key."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")).where("_id IS NOT NULL")
    lines = rows.select("_id", F.xxhash64("_t").alias("_th"), F.posexplode(F.split("_t", "\n")).alias("_pos", "_line"))
    keys = lines.select("_id", "_th", "_pos", ascii_lower(F.btrim("_line", F.lit(SPACE))).alias("_key")).where(F.length("_key") >= min_chars)
    return keys.select("_id", "_th", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit("line"), "_key").alias("_h2"))


def drop_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(_id, _th, _runs): the dropped lines of each document that loses any, as sorted (start, n) runs."""
    lines = cut(line_hashes(docs, id_col, text_col, min_chars), "lines")
    salts = max(SALTS, math.isqrt(lines.count() // LINES_A_SALT))
    lines = lines.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
    dealt = lines.repartitionByRange("_h1", "_h2", "_salt")
    first = dealt.withColumn("_first", F.first("_id").over(Window.partitionBy("_h1", "_h2", "_salt").orderBy("_id", "_pos")))
    later = first.where("_id > _first").select("_id", "_th", "_pos")
    heads = first.where("_id = _first").drop("_first", "_salt")
    heads = heads.withColumn("_first", F.first("_id").over(Window.partitionBy("_h1", "_h2").orderBy("_id", "_pos")))
    dropped = later.unionByName(heads.where("_id > _first").select("_id", "_th", "_pos"))
    own = Window.partitionBy("_id", "_th").orderBy("_pos")
    marked = dropped.repartition("_id", "_th").dropDuplicates(["_id", "_th", "_pos"]).withColumn("_island", F.col("_pos") - F.row_number().over(own))
    runs = marked.groupBy("_id", "_th", "_island").agg(F.min("_pos").alias("start"), F.count("*").cast("int").alias("n"))
    return runs.groupBy("_id", "_th").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("_runs"))


def kept_lines(lines: Column, runs: Column) -> Column:
    """The lines between the dropped runs, one slice per gap: linear in lines and runs."""
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["start"] + r["n"]))
    ends = F.concat(F.transform(runs, lambda r: r["start"]), F.array(F.size(lines)))
    gaps = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    return F.flatten(F.transform(gaps, lambda g: F.slice(lines, g["a"] + 1, g["b"] - g["a"])))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its text without the dropped lines (null stays null where nothing was dropped), plus
    _n_lines and _n_dropped."""
    # the row goes along as one struct: its columns may have any names
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_th"))
    joined, text = keyed.join(bitmaps, ["_id", "_th"], "left"), F.col("_row")[text_col]
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    kept = F.when(F.col("_runs").isNull(), text).otherwise(F.array_join(kept_lines(lines, F.col("_runs")), "\n"))
    n_dropped = F.coalesce(F.aggregate("_runs", F.lit(0), lambda a, r: a + r["n"]), F.lit(0))
    columns = [(kept if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns]
    return joined.select(*columns, F.size(lines).alias("_n_lines"), n_dropped.alias("_n_dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """Both steps: find repeated lines over all of ``docs``, then drop them."""
    return apply_bitmaps(docs, drop_bitmaps(docs, id_col, text_col, min_chars), id_col, text_col)
