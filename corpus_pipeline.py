"""From documents to packed sequences: quality, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import linededup, mixing, neardup, packing, quality
from lodestrata.llm.base import drop, fresh, keep, table

SHINGLE_WORDS = 5


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return quality.score_rows(docs, weights, score).where(F.col(score) >= quality.THRESHOLD).select(docs.columns)


def by_line(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that an earlier one holds; n_chars follows."""
    row = F.col("row")
    columns = [F.col("kept").alias("text") if c == "text" else F.length("kept").cast("long").alias(c) if c == "n_chars" else row[c].alias(c) for c in docs.columns]
    return linededup.with_kept_text(docs).select(columns)


def by_similarity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates (five words, 0.8), the one with the smallest id."""
    decided = neardup.near_duplicates(docs, SHINGLE_WORDS, 80)
    name = fresh(docs, "gone")
    gone = keep(decided.where("NOT kept").select(F.col("doc_id").alias(name)), "gone")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti").select(docs.columns)


def by_source(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality classifier", by_quality), ("line dedup", by_line), ("MinHash near-dedup", by_similarity), ("mixing sources to target weights", by_source), ("packing", packed)]

#: A trained classifier and a vocabulary's ids are beyond SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's documents are a table in the shared folder until the next stage has read them."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs, name.split()[0])
            drop(before)
            before = docs
    return docs
