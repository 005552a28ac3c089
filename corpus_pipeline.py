"""A corpus pipeline of five stages; each is written as Parquet and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapsmith.llm import decontaminate, jaccard, line_dedup, packing, toxicity
from mapsmith.llm.common import cut, table
from mapsmith.llm.queries import tokenizer_path
from mapsmith.plans.cutting import drop_cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, rejects go. A null or empty text gets the score of a
    text without known words and stays by the same rule; repeated rows are scored each for itself."""
    score = toxicity.scorer(toxicity.train(docs, table(spark, sf_dir, "labels")))
    return docs.where(score("text") < toxicity.THRESHOLD)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of an earlier document go; n_chars, if there is such a column, follows the text. Null texts stay null,
    rows without an id keep all lines, repeated rows are one document."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near-duplicates, the one of the least id stays (once, if its row is repeated). Null and
    empty texts are linked with nothing and stay; so do rows without an id."""
    out = jaccard.join(docs)
    gone = out.where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti").dropDuplicates(["doc_id", "text"])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of any benchmark item go (one item is enough: a model must not meet it). Null
    and empty texts hold none and stay; repeated rows are judged each by its own text."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of power-of-two lengths; a null or empty text is its end id alone."""
    pieces = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), 0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", one_of_each_group),
    ("decontaminate", drop_benchmark),
    ("packing", pack),
]

#: The first stage is a classifier and the last a tokenizer: tests/llm/test_pipeline.py checks against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
            if k:
                drop_cut(before)  # the next stage's table stands
    return docs
