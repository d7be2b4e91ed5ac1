"""Cleaning and splitting of texts, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .measure import SPACE, not_blank


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode's and U+001C to U+001F."""
    return F.regexp_replace(c, rf"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def clean(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, rf"(?U)[{SPACE}]+", " "))


def _long_enough(parts: Column, least: int) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: F.length(x) >= least)


def paragraphs(c: Column, least: int = 5) -> Column:
    """Parts between blank lines, if there is one; else nothing."""
    return F.when(F.contains(c, F.lit("\n\n")), _long_enough(F.split(c, "\n\n", -1), least)).otherwise(F.array().cast("array<string>"))


def lines(c: Column, least: int = 5) -> Column:
    return F.when(F.contains(c, F.lit("\n")), _long_enough(F.split(c, "\n", -1), least)).otherwise(F.array().cast("array<string>"))


def sentences(c: Column, least: int = 5) -> Column:
    return _long_enough(F.split(c, r"(?U)[.!?]+\s+", -1), least)


def chunks(c: Column, size: int = 500, most: int | None = 100) -> Column:
    """Pieces of size code points, stripped and not empty, at most most (all if None); a shorter text is itself."""
    n = F.length(c)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0))), lambda i: strip(F.substring(c, i * size + 1, F.lit(size))))
    some = F.filter(cut, lambda x: x != "")
    return F.when(n <= size, F.filter(F.array(c), not_blank)).otherwise(some if most is None else F.slice(some, 1, most))


def fallback_parts(c: Column, most: int = 100) -> Column:
    """Up to most parts: paragraphs, then new lines, then (if fewer than ten) new sentences; without any, chunks."""
    first = F.slice(paragraphs(c), 1, most)
    second = F.slice(F.concat(first, F.array_except(lines(c), first)), 1, most)
    third = F.when(F.size(second) < 10, F.slice(F.concat(second, F.array_except(sentences(c), second)), 1, most)).otherwise(second)
    size = F.least(F.lit(500), F.greatest(F.floor(F.length(c) / max(1, most)), F.lit(1))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.length(c) / size).cast("int")), lambda i: strip(F.substring(c, i * size + 1, size)))
    cut = F.slice(F.filter(cut, lambda x: x != ""), 1, most)
    return F.when(~not_blank(c), F.array().cast("array<string>")).when((F.size(third) == 0) & (F.length(c) > 5), cut).otherwise(third)


def normalize(c: Column) -> Column:
    """Runs of spaces become one, none beside a line break or at the ends."""
    one = F.regexp_replace(c, " +", " ")
    return strip(F.regexp_replace(F.regexp_replace(one, "\n ", "\n"), " \n", "\n"))


def without_sentence_tags(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<s>"), F.lit("")), F.lit("</s>"), F.lit(""))
