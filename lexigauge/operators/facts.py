"""The two fact tables that all metrics but the morphological ones come from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measure import Measure, n_units


@dataclass(frozen=True)
class Facts:
    """docs: a row for each tokenizer and text; counts: a row for each tokenizer, language and token; tokenizers: vocabulary sizes; held: docs is cached or stored."""

    docs: DataFrame
    counts: DataFrame
    tokenizers: DataFrame | None = None
    measure: Measure = Measure()
    held: bool = False


def text_facts(text: Column, measure: Measure = Measure(), n_tokens: Column | None = None) -> list[Column]:
    """n_units, n_chars, n_lines, has_text of a text. Missing texts have units only if words are counted and their tokens are known: half of them, at least one."""
    missing = text.isNull() | (text == "")
    guess = F.greatest(F.lit(1), F.floor(n_tokens * 0.5)).cast("bigint") if measure.method == "words" and n_tokens is not None else F.lit(0).cast("bigint")
    return [
        F.when(missing, guess).otherwise(n_units(text, measure)).alias("n_units"),
        F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars"),
        F.when(missing, 0).otherwise(F.size(F.split(text, "\n", -1))).cast("bigint").alias("n_lines"),
        (~missing).alias("has_text"),
    ]


def doc_facts(tokens: DataFrame, measure: Measure = Measure()) -> DataFrame:
    """Numbers of each text, without a shuffle."""
    n = F.size("tokens").cast("bigint")
    return tokens.select("tokenizer", "language", "doc_id", n.alias("n_tokens"), *text_facts(F.col("text"), measure, n))


def token_counts(tokens: DataFrame) -> DataFrame:
    """cnt by tokenizer, language and token; summed in each task before the one shuffle."""
    return tokens.select("tokenizer", "language", F.explode("tokens").alias("token")).groupBy("tokenizer", "language", "token").agg(F.count("*").alias("cnt"))


def facts(tokens: DataFrame, tokenizers: DataFrame | None = None, measure: Measure = Measure()) -> Facts:
    return Facts(doc_facts(tokens, measure), token_counts(tokens), tokenizers, measure)


def with_groups(table: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of table once for each group their language is in; groups is a small table by its nature (languages)."""
    return table.join(F.broadcast(groups.select("group_type", "group_name", "language").distinct()), "language")
