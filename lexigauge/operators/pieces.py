"""Encoding by a dictionary: each distinct piece of a corpus is encoded once.

Texts are cut where a tokenizer always ends a token (its cut), pieces are counted, and the table of
distinct pieces with their tokens is stored. Token counts are then sums over that table, and the length of a
text is the sum of its pieces' lengths, which come by a join. Pieces that make up a fixed share of all
occurrences or more can only be few; they join by broadcast, so that none of them is a hot key, and only the
others are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.measure import Measure, not_blank
from ..session import kept
from .encode import Tokenizer, tokenizers_table
from .facts import Facts, text_facts

#: A piece is hot if it is this share of all occurrences; so there are HOT hot pieces at most.
HOT = 4096


def parts(text: Column, cut: str) -> Column:
    return F.filter(F.split(text, cut, -1), lambda p: p != "")


def by_cut(tokenizers: Sequence[Tokenizer]) -> dict[str, list[Tokenizer]]:
    """Tokenizers that share a cut; ValueError for those without one, whose texts have no pieces."""
    out: dict[str, list[Tokenizer]] = {}
    for t in tokenizers:
        if t.cut is None or t.preprocess:
            raise ValueError(f"{t.name} has no cut at which every text falls into pieces that encode alike wherever they stand")
        out.setdefault(t.cut, []).append(t)
    return out


#: What tells texts apart: 128 bits of their content. The length of a text depends on nothing else, so ids may repeat or be null.
TEXT = ("d0", "d1")


def texts(corpus: DataFrame) -> DataFrame:
    """Texts that are not blank, with their digest."""
    x = corpus.where(F.col("text").isNotNull() & not_blank(F.col("text")))
    return x.withColumns({d: F.xxhash64(F.lit(i), "text") for i, d in enumerate(TEXT)})


def occurrences(corpus: DataFrame, cut: str) -> DataFrame:
    """d0, d1, language, at, piece: every piece of every text that is not blank, with its place."""
    return texts(corpus).select(*TEXT, "language", F.posexplode(parts(F.col("text"), cut)).alias("at", "piece"))


def dictionary(corpus: DataFrame, tokenizers: Sequence[Tokenizer]) -> DataFrame:
    """piece, langs (language, n), n, tokens (an array a tokenizer): each piece counted in tasks first, then encoded once.

    All tokenizers have one cut. The languages of a piece are few by nature.
    """
    counted = occurrences(corpus, tokenizers[0].cut).groupBy("piece", "language").agg(F.count("*").alias("n"))
    pieces = counted.groupBy("piece").agg(F.collect_list(F.struct("language", "n")).alias("langs"), F.sum("n").alias("n"))
    return pieces.withColumn("tokens", F.array(*[t.encode(F.col("piece")).cast("array<string>") for t in tokenizers]))


def counts(pieces: DataFrame, tokenizers: Sequence[Tokenizer]) -> DataFrame:
    """tokenizer, language, token, cnt from a dictionary: what a piece holds, times how often it stands in a language."""
    names = F.array(*[F.lit(t.name) for t in tokenizers])
    x = pieces.select("langs", F.explode(F.arrays_zip(names.alias("tokenizer"), F.col("tokens"))).alias("t"))
    x = x.select("langs", F.col("t.tokenizer").alias("tokenizer"), F.explode("t.tokens").alias("token"))
    x = x.select("tokenizer", "token", F.explode("langs").alias("l")).select("tokenizer", "l.language", "token", "l.n")
    return x.groupBy("tokenizer", "language", "token").agg(F.sum("n").alias("cnt"))


def lengths(corpus: DataFrame, pieces: DataFrame, tokenizers: Sequence[Tokenizer], hot: int = HOT) -> DataFrame:
    """d0, d1, and n0, n1, ...: tokens of each distinct text by each tokenizer."""
    n = [f"n{i}" for i in range(len(tokenizers))]
    known = pieces.select("piece", "n", *[F.size(F.col("tokens")[i]).cast("bigint").alias(c) for i, c in enumerate(n)])
    total = known.agg(F.sum("n")).first()[0] or 0
    # hot pieces that occur total / hot times or more each: hot of them at most
    often = F.col("n") * hot >= total
    few = known.where(often).select("piece", *n)
    # the first piece of a text counts its copies
    seen = occurrences(corpus, tokenizers[0].cut).select(*TEXT, (F.col("at") == 0).cast("bigint").alias("copies"), "piece")
    both = seen.join(F.broadcast(few), "piece", "left")
    sums = [F.sum(c).alias(c) for c in ("copies", *n)]
    quick = both.where(F.col(n[0]).isNotNull()).groupBy(*TEXT).agg(*sums)
    slow = both.where(F.col(n[0]).isNull()).select(*TEXT, "copies", "piece").join(known.where(~often).select("piece", *n), "piece").groupBy(*TEXT).agg(*sums)
    total = quick.unionByName(slow).groupBy(*TEXT).agg(*sums)
    return total.select(*TEXT, *[(F.col(c) / F.col("copies")).cast("bigint").alias(c) for c in n])


def facts_by_pieces(corpus: DataFrame, tokenizers: Sequence[Tokenizer], measure: Measure = Measure(), hot: int = HOT) -> Facts:
    """The fact tables of corpus (doc_id, language, text), each distinct piece encoded once."""
    corpus = corpus.select("doc_id", "language", "text")
    own = texts(corpus).select(*TEXT, "language", "doc_id", *text_facts(F.col("text"), measure))
    docs, cnts = [], []
    for ts in by_cut(tokenizers).values():
        pieces = kept(dictionary(corpus, ts), "pieces")
        n = lengths(corpus, pieces, ts, hot)
        each = F.explode(F.array(*[F.struct(F.lit(t.name).alias("tokenizer"), F.col(f"n{i}").alias("n_tokens")) for i, t in enumerate(ts)]))
        x = own.join(n, [*TEXT]).withColumn("e", each).where("e.n_tokens > 0")
        docs.append(x.select("e.tokenizer", "language", "doc_id", "e.n_tokens", "n_units", "n_chars", "n_lines", "has_text"))
        cnts.append(counts(pieces, ts))
    both = [reduce(DataFrame.unionByName, x) for x in (docs, cnts)]
    return Facts(*both, tokenizers_table(corpus.sparkSession, list(tokenizers)), measure)


def encoded_characters(corpus: DataFrame, tokenizers: Sequence[Tokenizer]) -> DataFrame:
    """tokenizer, in_texts, in_pieces, occurrences, pieces: characters that go through the tokenizer text by text and by the dictionary."""
    out = []
    for cut, ts in by_cut(tokenizers).items():
        n = F.col("n")
        x = occurrences(corpus, cut).groupBy("piece").agg(F.count("*").alias("n")).agg(F.sum(n * F.length("piece")).alias("in_texts"), F.sum(F.length("piece")).cast("bigint").alias("in_pieces"), F.sum(n).alias("occurrences"), F.count("*").alias("pieces"))
        out.append(x.select(F.explode(F.array(*[F.lit(t.name) for t in ts])).alias("tokenizer"), "in_texts", "in_pieces", "occurrences", "pieces"))
    return reduce(DataFrame.unionByName, out)
