"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN

def held_out(id_col: str, folds: int, fold: int):
    """crc32 of the id as text, modulo folds, is fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


#: Of the random choice of rows: the same rows of the same table are chosen again.
SEED = 23


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """About rows rows of df, or all if it has fewer. Rows are chosen one by one, whatever they hold, so null and repeated ids are no special case."""
    n = df.count()
    return df if n <= rows else df.where(F.rand(SEED) < rows / n)


def bounded_each(df: DataFrame, by: str, rows: int) -> DataFrame:
    """About rows rows of df for each value of by (a few strings, null left out), or all of those that have fewer."""
    value = F.col(by).cast("string")
    bound = F.lit(1.0)
    for r in df.where(F.col(by).isNotNull()).groupBy(value.alias("v")).agg(F.count("*").alias("n")).collect():
        if r["n"] > rows:
            bound = F.when(value == r["v"], rows / r["n"]).otherwise(bound)
    return df.where(F.col(by).isNotNull() & (F.rand(SEED) < bound))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, balanced: bool = False) -> DataFrame:
    """A bounded sample of labelled texts: id, y, text and weight (what a row stands for), the names prefixed.

    balanced: as many rows of each of a few labels as can be. The sample's ids (about rows at
    most) are broadcast, and the texts are only read for them; where ids repeat in docs, rows
    are chosen once more. Rows without a label or text are left out; of repeated labels
    of one id the largest counts.
    """
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias(OWN + "id"), F.col(label_col).cast("double").alias(OWN + "y"))
    y = y.groupBy(OWN + "id").agg(F.max(OWN + "y").alias(OWN + "y"))
    share = F.lit(1.0)
    if balanced:
        counts = {r[0]: r["n"] for r in y.groupBy(OWN + "y").agg(F.count("*").alias("n")).collect()}
        for value, n in counts.items():
            share = F.when(F.col(OWN + "y") == value, min(1.0, rows / len(counts) / n)).otherwise(share)
    else:
        share = F.lit(min(1.0, rows / max(1, y.count())))
    # ids are unique here, so a hash of them is as good as chance, and does not depend on the order of rows
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(OWN + "id").cast("string")), 11) / float(1 << 53)
    y = y.withColumn(OWN + "weight", 1 / share).where(chance < share)
    ids = docs.select(F.col(id_col).alias(OWN + "id"))
    n = ids.join(F.broadcast(y), OWN + "id").count()
    x = docs.select(F.col(id_col).alias(OWN + "id"), F.col(text_col).cast("string").alias(OWN + "text")).where(F.col(OWN + "text").isNotNull())
    x = x.join(F.broadcast(y), OWN + "id")
    return x if n <= 1.25 * rows else x.where(F.rand(SEED) < rows / n)
