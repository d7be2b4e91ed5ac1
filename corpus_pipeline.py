"""A corpus pipeline: select, deduplicate, decontaminate, redact, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's
rows as Parquet in the shared folder and hands them, read again, to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigauge.llm import decontam, dedup, packing, pii, quality
from lexigauge.llm.common import stored, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade above the lowest is a half or more, row by row.

    Null and empty texts are judged by their emptiness; without labels everything stays; an
    empty table stays empty. Here and below very long texts are read whole and extra
    columns are kept.
    """
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one of the least id: five-word shingles, similarity 0.8.

    Null and empty texts are no group: of repeated rows of one id one stays. Null ids count as the largest.
    """
    return dedup.distinct_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, row by row; null and empty texts have no words and stay, as all do if the benchmark is empty."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, row by row; n_chars follows the text; null texts stay null."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the encoded documents with their place in sequences of 1024 tokens; null and empty texts are an end id alone."""
    return packing.packed(docs)


STAGES = [
    ("quality classifier", select_quality),
    ("near-duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("personal data", redact),
    ("packing", pack),
]

#: Learned weights decide the first stage, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
