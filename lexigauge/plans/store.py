"""Fact tables that are kept: encoded once, bucketed, found by name in the session's catalog.

Facts of documents are bucketed by document and token counts by token, so that metrics which put
tokenizers side by side join without a shuffle, and every metric reads numbers in place of texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measure import Measure
from ..operators.facts import Facts

#: Buckets of a table. A bucket should hold some hundred MB: choose more for larger corpora.
BUCKETS = 64


class FactStore:
    """Tables under a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, folder: str, prefix: str = "facts"):
        self.spark, self.folder, self.prefix = spark, folder.rstrip("/"), prefix

    def _name(self, name: str, part: str) -> str:
        return f"{self.prefix}_{name}_{part}"

    def save(self, name: str, facts: Facts, buckets: int = BUCKETS) -> Facts:
        """The facts as stored: a partition for each tokenizer, docs bucketed by doc_id and counts by token. An earlier table of the name is replaced."""
        for part, df, by in (("docs", facts.docs, "doc_id"), ("counts", facts.counts, "token")):
            table = self._name(name, part)
            self.spark.sql(f"DROP TABLE IF EXISTS `{table}`")
            # a bucket is one file, whose rows one task has
            out = df.repartition(buckets, by).write.mode("overwrite").partitionBy("tokenizer").bucketBy(buckets, by).sortBy(by)
            out.option("path", f"{self.folder}/{table}").saveAsTable(table)
        if facts.tokenizers is not None:
            facts.tokenizers.write.mode("overwrite").parquet(f"{self.folder}/{self._name(name, 'tokenizers')}")
        return self.load(name, facts.measure, facts.tokenizers is not None)

    def load(self, name: str, measure: Measure = Measure(), sized: bool = True) -> Facts:
        """Stored facts; measure is the one that they were made with."""
        sizes = self.spark.read.parquet(f"{self.folder}/{self._name(name, 'tokenizers')}") if sized else None
        return Facts(self.spark.table(self._name(name, "docs")), self.spark.table(self._name(name, "counts")), sizes, measure, True)

    def names(self) -> list[str]:
        found = [t.name for t in self.spark.catalog.listTables() if t.name.startswith(f"{self.prefix}_") and t.name.endswith("_docs")]
        return sorted(n[len(self.prefix) + 1 : -len("_docs")] for n in found)

    def drop(self, name: str) -> None:
        """Forget the tables; their files stay in the folder."""
        for part in ("docs", "counts"):
            self.spark.sql(f"DROP TABLE IF EXISTS `{self._name(name, part)}`")


def side_by_side(facts: Facts, first: str, second: str) -> DataFrame:
    """doc_id, language, first, second: tokens of each document by two tokenizers. Ids must be unique; documents that one of them has no tokens for are left out."""
    a = facts.docs.where(F.col("tokenizer") == first).select("doc_id", "language", F.col("n_tokens").alias("first"))
    b = facts.docs.where(F.col("tokenizer") == second).select("doc_id", F.col("n_tokens").alias("second"))
    return a.join(b, "doc_id")


def shared_tokens(facts: Facts, first: str, second: str) -> DataFrame:
    """token, first, second: how often two tokenizers give the tokens that both have, over all languages."""
    each = [facts.counts.where(F.col("tokenizer") == t).groupBy("token").agg(F.sum("cnt").alias(n)) for t, n in ((first, "first"), (second, "second"))]
    return each[0].join(each[1], "token")
