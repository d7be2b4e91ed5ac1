"""Checks of tokenized data, as one frame of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def rules(tokens: DataFrame, tokenizers: DataFrame | None = None, languages: list[str] | None = None) -> tuple[DataFrame, list[tuple[str, str, Column]]]:
    """tokens with what the rules need, and severity, name and condition of each rule."""
    t = tokens.withColumn("__ids", F.transform("tokens", lambda x: x.try_cast("int")))
    if tokenizers is not None:
        t = t.join(F.broadcast(tokenizers.select("tokenizer", F.col("vocab_size").alias("__size"))), "tokenizer", "left")
    else:
        t = t.withColumn("__size", F.lit(None).cast("bigint"))
    found = [
        ("error", "no_language", F.col("language").isNull() | (F.col("language") == "")),
        ("error", "no_tokens", F.col("tokens").isNull() | (F.size("tokens") == 0)),
        ("error", "negative_id", F.exists("__ids", lambda x: x < 0)),
        ("error", "id_beyond_vocabulary", F.col("__size").isNotNull() & F.exists("__ids", lambda x: x >= F.col("__size"))),
        ("warning", "more_tokens_than_characters", F.col("text").isNotNull() & (F.size("tokens") > F.length("text"))),
        ("warning", "no_text", F.col("text").isNull()),
    ]
    if languages is not None:
        found.append(("warning", "unexpected_language", ~F.col("language").isin(languages)))
    return t, [(s, n, F.coalesce(c, F.lit(False))) for s, n, c in found]


def violations(tokens: DataFrame, tokenizers: DataFrame | None = None, languages: list[str] | None = None) -> DataFrame:
    """tokenizer, severity, rule, n of each rule that is broken, from one aggregation.

    Errors: rows without tokenizer, language or tokens, negative ids, ids not below the
    vocabulary size. Warnings: more tokens than characters, unexpected languages, no text.
    """
    t, found = rules(tokens, tokenizers, languages)
    counts = t.groupBy(F.coalesce("tokenizer", F.lit("")).alias("tokenizer")).agg(*[F.count_if(c).alias(n) for _, n, c in found])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(n).alias("rule"), F.col(n).alias("n")) for s, n, _ in found]))
    return counts.select("tokenizer", rows.alias("r")).select("tokenizer", "r.*").where("n > 0")


class Watch:
    """Rules that are counted while tokens are read for something else, so that checking reads nothing again.

    Use frame in place of the tokens. After the first action over all of it, found() has severity, rule, n
    and the first tokenizer of each broken rule, and check() raises ValueError on errors. Without an action they would wait for one.
    """

    def __init__(self, tokens: DataFrame, tokenizers: DataFrame | None = None, languages: list[str] | None = None):
        t, self._rules = rules(tokens, tokenizers, languages)
        self._seen = Observation()
        each = [m for _, n, c in self._rules for m in (F.count_if(c).alias(n), F.min(F.when(c, F.coalesce("tokenizer", F.lit("")))).alias(f"{n}_at"))]
        self.frame = t.observe(self._seen, *each).select(*tokens.columns)

    def found(self) -> list[tuple[str, str, int, str]]:
        got = self._seen.get
        return [(s, n, got[n], got[f"{n}_at"]) for s, n, _ in self._rules if got[n]]

    def check(self) -> None:
        if bad := [x for x in self.found() if x[0] == "error"]:
            raise ValueError("; ".join(f"{t}: {rule} ({n})" for _, rule, n, t in bad))


def checked(tokens: DataFrame, tokenizers: DataFrame | None = None) -> DataFrame:
    """tokens, or ValueError if an error is found."""
    bad = violations(tokens, tokenizers).where("severity = 'error'").collect()
    if bad:
        raise ValueError("; ".join(f"{r.tokenizer}: {r.rule} ({r.n})" for r in sorted(bad)[:5]))
    return tokens


def coverage(tokens: DataFrame, expected: DataFrame) -> DataFrame:
    """Tokenizer and language pairs of expected that are missing, and those that are unexpected."""
    have = tokens.select("tokenizer", "language").distinct()
    want = expected.select("tokenizer", "language").distinct()
    return want.exceptAll(have).withColumn("problem", F.lit("missing")).unionByName(have.exceptAll(want).withColumn("problem", F.lit("unexpected")))


def statistics(tokens: DataFrame) -> DataFrame:
    """Totals by tokenizer: texts, tokens, languages, least and most tokens of a text, share of rows with text."""
    n = F.size("tokens").cast("bigint")
    return tokens.groupBy("tokenizer").agg(
        F.count("*").alias("texts"), F.sum(n).alias("tokens"), F.countDistinct("language").alias("languages"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(F.col("text").isNotNull().cast("double")).alias("text_share")
    )


def estimated_vocabulary(tokens: DataFrame) -> DataFrame:
    """tokenizer, vocab_size: the largest id plus one, where no vocabulary is given."""
    ids = F.array_max(F.transform("tokens", lambda x: x.try_cast("bigint")))
    return tokens.groupBy("tokenizer").agg((F.max(ids) + 1).alias("vocab_size"))
