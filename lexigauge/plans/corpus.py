"""Corpora from tables, and tokens of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.measure import Measure
from ..operators.encode import Tokenizer, encode, tokenizer, tokenizers_table
from ..operators.facts import Facts, facts
from ..operators.library_facts import by_libraries, library_facts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, language, text, source of the documents table; the columns that a query doesn't need are pruned from the scan."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("lang").alias("language"), "text", "source")


def capped(corpus: DataFrame, most: int, order: list[str]) -> DataFrame:
    """The first most texts of each language in the given order."""
    w = Window.partitionBy("language").orderBy(*order)
    return corpus.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def native_tokenizers() -> list[Tokenizer]:
    return [tokenizer("word_punct"), tokenizer("whitespace")]


def document_facts(spark: SparkSession, sf_dir: str, measure: Measure = Measure(), tokenizers: list[Tokenizer] | None = None) -> Facts:
    ts = tokenizers or native_tokenizers()
    if by_libraries(ts):
        return library_facts(documents(spark, sf_dir), ts, tokenizers_table(spark, ts), measure)
    return facts(encode(documents(spark, sf_dir), ts), tokenizers_table(spark, ts), measure)
