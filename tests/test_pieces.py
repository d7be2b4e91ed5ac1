"""Encoding by a dictionary of pieces against encoding text by text."""

import pytest
from pyspark.sql import functions as F

from lexigauge.functions.measure import PRESETS
from lexigauge.operators import metrics as M
from lexigauge.operators.encode import encode, tokenizer
from lexigauge.operators.facts import facts
from lexigauge.operators.pieces import dictionary, encoded_characters, facts_by_pieces, lengths

# One word is a third of all; ids repeat and are null; texts hold white space that is no cut.
ROWS = [(1, "en", "the cat the\tdog the the"), (1, "en", "the, the. the"), (None, None, "a b\n\nthe "), (2, "de", "  "), (3, None, None), (4, "de", ""), (5, "fr", "the " * 300 + "end."), (6, "fr", "no-break don't\x1cstop"), (7, "en", "x" * 5000), (8, "de", " 東京 the  ")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(ROWS, "doc_id long, language string, text string").repartition(3)


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def byte_bpe():
    import public_tokenizers as P

    return tokenizer("huggingface", name="byte_bpe", path=P.path("byte_bpe_50k.json"), cut=r"(?U)(?<=\S)(?=\s)")


@pytest.mark.parametrize("hot", [1, 3, 4096])
def test_same_facts(corpus, hot):
    """Also where every piece is hot, some are, or one is."""
    ts = [tokenizer(n) for n in ("whitespace", "word_punct", "hf_whitespace", "char", "regex")] + [byte_bpe()]
    want = facts(encode(corpus, ts), None, PRESETS["words"])
    got = facts_by_pieces(corpus, ts, PRESETS["words"], hot)
    assert rows(got.counts) == rows(want.counts)
    assert rows(got.docs) == rows(want.docs)


def test_tables(spark):
    """Whole texts of the documents table, by a tokenizer from a file."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("lang").alias("language"), "text")
    want, got = facts(encode(docs, [byte_bpe()])), facts_by_pieces(docs, [byte_bpe()])
    assert rows(got.counts) == rows(want.counts) and rows(got.docs) == rows(want.docs)
    assert rows(M.unigram(got).select("language", "pooled", "total_tokens")) == rows(M.unigram(want).select("language", "pooled", "total_tokens"))
    x = encoded_characters(docs, [byte_bpe()]).first()
    assert x.in_pieces < x.in_texts and x.pieces < x.occurrences


def test_hot_pieces(corpus):
    """Only pieces that are not hot are shuffled, and the dictionary holds each piece once."""
    ts = [tokenizer("whitespace")]
    pieces = dictionary(corpus, ts).cache()
    assert pieces.count() == pieces.select("piece").distinct().count()
    plan = lengths(corpus, pieces, ts, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
    assert {r.n0 for r in lengths(corpus, pieces, ts, 3).collect()} == {6, 3, 301, 2, 1}


def test_without_cut(corpus):
    for t in (tokenizer("regex", name="own", pattern="a+"), tokenizer("whitespace", preprocess="bytes")):
        with pytest.raises(ValueError, match="no cut"):
            facts_by_pieces(corpus, [t])
    none = facts_by_pieces(corpus.where("1 = 0"), [tokenizer("char")])
    assert none.docs.count() == 0 and none.counts.count() == 0
