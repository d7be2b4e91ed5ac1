"""Numbers of types by mergeable sketches: a fast form of what the counts of tokens give exactly.

A sketch for each tokenizer and language is stored once; sketches of all languages, and of groups of
them, are unions of those, so nothing is counted again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import ratio

#: Base-2 logarithm of a sketch's size; the relative error of merged sketches is about 1.04 / sqrt(2^LOG_SIZE), here 1.6 %.
LOG_SIZE = 12


def relative_error(log_size: int = LOG_SIZE) -> float:
    """Standard error of a sketch that was merged, as all here are: tasks' sketches are united. (0.83 holds only for one that saw all its values itself.)"""
    return 1.04 / 2 ** (log_size / 2)


def type_sketches(tokens: DataFrame, log_size: int = LOG_SIZE) -> DataFrame:
    """tokenizer, language, sketch, tokens: one pass over tokens; only sketches are shuffled."""
    x = tokens.select("tokenizer", "language", F.explode("tokens").alias("token"))
    return x.groupBy("tokenizer", "language").agg(F.hll_sketch_agg("token", F.lit(log_size)).alias("sketch"), F.count("*").alias("tokens"))


def rolled_up(sketches: DataFrame, keys: Sequence[str] = ("tokenizer",)) -> DataFrame:
    """types (estimated), tokens, ttr by keys and language, and by keys alone (pooled). sketches may be joined to groups."""
    own = sketches.select(*keys, "language", F.lit(False).alias("pooled"), "sketch", "tokens")
    every = sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("tokens").alias("tokens"))
    every = every.select(*keys, F.lit(None).cast("string").alias("language"), F.lit(True).alias("pooled"), "sketch", "tokens")
    x = own.unionByName(every).withColumn("types", F.hll_sketch_estimate("sketch"))
    return x.select(*keys, "language", "pooled", "types", "tokens", ratio(F.col("types"), F.col("tokens")).alias("ttr"))
