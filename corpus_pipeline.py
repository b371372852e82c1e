"""The corpus pipeline: quality, repeated lines, near duplicates, benchmark leaks, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as
Parquet in the shared folder and reads it as the next one's ``docs``. All stages but the last return the columns of
``documents``. Rows with null texts count as empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from daygrain.llm.common import as_table, read_table
from daygrain.llm.decontaminate import contamination
from daygrain.llm.line_dedup import dedup_lines
from daygrain.llm.quality_gbt import classify
from daygrain.llm.sentencepiece_codec import round_trip
from daygrain.llm.simhash import first_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    scored = classify(docs, read_table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    return scored.where("predicted = 1").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that a document of smaller id has; a document without lines left stays, with an empty text."""
    kept = dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("kept").cast(docs.schema["n_chars"].dataType))
    return kept.withColumn("text", F.col("kept")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near duplicates."""
    return first_of_each(docs, shingle_words=3, max_bits=3).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    found = contamination(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]), out="_matches")
    return found.where(F.size("_matches") == 0).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids, and whether they decode to its text."""
    both = round_trip(docs)
    return both.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("tokenize", tokenize)]

#: The classifier's trees and the piece merges have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = as_table(stage(spark, docs, sf_dir))
    return docs
