"""Vocabularies from counts, and from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(counts: DataFrame) -> DataFrame:
    """tokenizer, token, token_id: ids from 0 by falling count, ties by token.

    Tokens are numbered within parts (a count and a first character) and shifted by the
    tokens of the parts before, so that no window holds a whole vocabulary.
    """
    c = counts.groupBy("tokenizer", "token").agg(F.sum("cnt").alias("cnt"))
    part = F.struct((-F.col("cnt")).alias("k"), F.substring("token", 1, 1).alias("s"))
    c = c.withColumn("part", part)
    sizes = c.groupBy("tokenizer", "part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("tokenizer").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("tokenizer", "part").orderBy("token")
    out = c.withColumn("i", F.row_number().over(w)).join(before, ["tokenizer", "part"])
    return out.select("tokenizer", "token", (F.coalesce("before", F.lit(0)) + F.col("i") - 1).alias("token_id"))
