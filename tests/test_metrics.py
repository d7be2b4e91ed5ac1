"""Metrics against plain Python over a small corpus."""

import math
from collections import Counter, defaultdict
from statistics import mean, median, pstdev, stdev

import pytest

from lexigauge.operators import metrics as M
from lexigauge.operators.encode import encode, from_config, register_tokenizer, tokenizer, tokenizers_table, vocabulary
from lexigauge.operators.facts import facts, with_groups
from lexigauge.operators.validate import checked, coverage, estimated_vocabulary, statistics, violations

DOCS = [(1, "en", "the cat sat on the mat"), (2, "en", "the dog"), (3, "de", "der Hund und die Katze"), (4, "fr", "le chat\nle chien"), (5, "fr", "   "), (6, "de", None)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id long, language string, text string")


@pytest.fixture(scope="module")
def built(spark, corpus):
    ts = [tokenizer("whitespace"), tokenizer("char")]
    t = encode(corpus, ts)
    return t, facts(t, tokenizers_table(spark, ts))


def plain():
    by = defaultdict(list)
    for _, lang, text in DOCS:
        if text and text.strip():
            by[lang].append((text, text.split()))
    return by


def test_fertility(built):
    by = plain()
    got = {r.language: r for r in M.fertility(built[1]).where("tokenizer = 'whitespace'").collect()}
    x = [len(k) / len(t.encode()) for v in by.values() for t, k in v]
    assert got[None]["mean"] == pytest.approx(mean(x))
    assert got[None]["median"] == pytest.approx(median(x))
    assert got[None]["std"] == pytest.approx(pstdev(x))
    assert got[None]["std_err"] == pytest.approx(stdev(x) / len(x) ** 0.5)
    assert got["de"]["std_err"] is None and got["de"]["count"] == 1


def test_entropy_and_ranks(built):
    by = plain()
    got = {r.language: r for r in M.unigram(built[1]).where("tokenizer = 'whitespace'").collect()}
    ren = {(r.language, r.alpha): r.entropy for r in M.renyi(built[1]).where("tokenizer = 'whitespace'").collect()}
    groups = {**{k: Counter(w for _, t in v for w in t) for k, v in by.items()}}
    groups[None] = sum(groups.values(), Counter())
    for lang, c in groups.items():
        n = sum(c.values())
        p = [v / n for v in c.values()]
        assert got[lang].unigram_entropy == pytest.approx(-sum(x * math.log2(x) for x in p))
        assert got[lang].avg_token_rank == pytest.approx(sum(i * v for i, (_, v) in enumerate(c.most_common(), 1)) / n)
        assert (got[lang].total_tokens, got[lang].unique_tokens) == (n, len(c))
        for a in (2.0, 2.5, 3.0):
            assert ren[lang, a] == pytest.approx(math.log2(sum(x**a for x in p)) / (1 - a))


def test_fairness(built):
    by = plain()
    cost = {k: sum(len(t) for _, t in v) / sum(len(x.encode()) for x, _ in v) for k, v in by.items()}
    m, n = mean(cost.values()), len(cost)
    want = sum(abs(a - b) for a in cost.values() for b in cost.values()) / (2 * n * n * m)
    g = M.gini(built[1]).where("tokenizer = 'whitespace'").first()
    assert g.gini_coefficient == pytest.approx(want)
    assert g.most_efficient_language == min(cost, key=cost.get)
    curve = sorted((r.i, r.x, r.y) for r in M.lorenz(built[1]).where("tokenizer = 'whitespace'").collect())
    assert curve[0] == (0, 0.0, 0.0) and curve[-1][1:] == (1.0, pytest.approx(1.0))


def test_one_language(built):
    f = built[1]
    one = type(f)(f.docs.where("language = 'en'"), f.counts.where("language = 'en'"), f.tokenizers)
    assert M.gini(one).first().gini_coefficient == 0.0
    assert M.lorenz(one).count() == 0


def test_pairs_and_groups(spark, built):
    p = M.pairwise(M.fertility(built[1]).where("pooled"), "mean").collect()
    assert [(r.tokenizer_1, r.tokenizer_2) for r in p] == [("char", "whitespace")]
    g = spark.createDataFrame([("f", "ger", "en"), ("f", "ger", "de"), ("f", "all", "en")], "group_type string, group_name string, language string")
    f = built[1]
    x = M.fertility(type(f)(with_groups(f.docs, g), f.counts), ("tokenizer", "group_type", "group_name")).where("pooled and tokenizer = 'char'")
    assert {r.group_name: r["count"] for r in x.collect()} == {"ger": 3, "all": 2}


def test_validation(spark, built):
    t, f = built
    assert checked(t) is t
    bad = spark.createDataFrame([("t", "en", 1, "ab", ["1", "-2", "9"]), ("t", "", 2, None, [])], "tokenizer string, language string, doc_id long, text string, tokens array<string>")
    sizes = spark.createDataFrame([("t", 5)], "tokenizer string, vocab_size long")
    assert {r.rule: r.n for r in violations(bad, sizes, ["en"]).collect()} == {"no_language": 1, "no_tokens": 1, "negative_id": 1, "id_beyond_vocabulary": 1, "more_tokens_than_characters": 1, "no_text": 1, "unexpected_language": 1}
    with pytest.raises(ValueError):
        checked(bad, sizes)
    assert estimated_vocabulary(bad).first().vocab_size == 10
    want = spark.createDataFrame([("char", "en"), ("char", "sr")], "tokenizer string, language string")
    assert ("sr", "missing") in {(r.language, r.problem) for r in coverage(t, want).collect()}
    assert {r.tokenizer: r.texts for r in statistics(t).collect()} == {"char": 4, "whitespace": 4}


def test_empty(spark):
    ts = [tokenizer("char")]
    f = facts(encode(spark.createDataFrame([], "doc_id long, language string, text string"), ts), tokenizers_table(spark, ts))
    for m in (M.fertility, M.token_length, M.compression, M.type_token_ratio, M.renyi, M.unigram, M.gini, M.lorenz, M.tokens_per_line):
        assert [r for r in m(f).collect() if r["tokenizer"]] == []


def test_stored_tokenizers(spark, corpus):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    ts, shown = from_config({"bpe": {"class": "huggingface", "path": P.path("byte_bpe_50k.json")}, "sp": {"class": "sentencepiece", "path": P.path("piece_bpe_32k.model"), "bos": True}, "rank": {"class": "ranked", "path": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN, "vocab": False}, "plot_tokenizers": ["bpe"]})
    assert shown == ["bpe"]
    got = {(r.tokenizer, r.doc_id): r.tokens for r in encode(corpus, ts).collect()}
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, _, text in DOCS[:4]:
        assert got["bpe", i] == [str(x) for x in lib.encode(text).ids] == got["rank", i]
        assert got["sp", i][0] == "1"
    assert ts[0].vocab_size == 50257 and ts[1].unk_id == 0
    u = M.unknown_share(encode(corpus, ts[1:2]), tokenizers_table(spark, ts)).where("pooled").first()
    assert u["mean"] == 0.0
    assert vocabulary(spark, ts[:1]).count() == 50257
    from pyspark.sql import functions as F

    text = corpus.where("doc_id = 1").select(ts[0].decode(ts[0].tokens(F.col("text"))).alias("t"), ts[1].pieces(F.col("text")).alias("p")).first()
    assert text.t == DOCS[0][2] and "".join(text.p).replace("▁", " ").strip() == DOCS[0][2]


def test_registry():
    with pytest.raises(ValueError):
        tokenizer("none")
    register_tokenizer("mine", lambda c: tokenizer("char", name=c["name"]))
    assert tokenizer("mine", name="x").name == "x"
    with pytest.raises(ValueError):
        from_config({"a": {"class": "char"}, "plot_tokenizers": ["b"]})


def test_null_languages(spark):
    """Texts without a language have rows of their own, and are counted once over all."""
    rows = [(1, "en", "a b c"), (2, None, "a d"), (3, None, "a")]
    ts = [tokenizer("whitespace")]
    f = facts(encode(spark.createDataFrame(rows, "doc_id long, language string, text string"), ts), tokenizers_table(spark, ts))
    key = lambda r: (r["language"], r["pooled"])
    assert {key(r): (r.types, r.tokens) for r in M.type_token_ratio(f).collect()} == {("en", False): (3, 3), (None, False): (2, 3), (None, True): (4, 6)}
    assert {key(r): r.used_tokens for r in M.vocabulary_utilization(f).collect()} == {("en", False): 3, (None, False): 2, (None, True): 4}
    assert {key(r): r["count"] for r in M.fertility(f).collect()} == {("en", False): 1, (None, False): 2, (None, True): 3}
    assert {key(r): r.total_tokens for r in M.unigram(f).collect()} == {("en", False): 3, (None, False): 3, (None, True): 6}
    assert {key(r): r.entropy for r in M.renyi(f, (1.0,)).collect()}[None, False] == pytest.approx(math.log2(3) - 2 / 3)
    assert {r.language for r in M.language_costs(f).collect()} == {"en", None}


@pytest.mark.parametrize("held", [True, False])
def test_statistics_of_large_values(spark, held):
    """The spread is that around the mean, also where the mean is large; medians fall between bins too."""
    import random

    rng = random.Random(4)
    groups = {"far": [1e8 + i % 2 for i in range(1000)], "same": [3.5] * 7, "zero": [0.0, 0.0, 8.0], "two": [1.0, 9.0], "any": [rng.lognormvariate(0, 2) for _ in range(501)], None: [0.0, 1e-9, 5.0]}
    df = spark.createDataFrame([("t", g, v) for g, x in groups.items() for v in x], "tokenizer string, language string, v double")
    got = {(r.language, r.pooled): r for r in M.statistics(df, df["v"], ["tokenizer"], held=held).collect()}
    groups = {(k, False): v for k, v in groups.items()} | {(None, True): [v for x in groups.values() for v in x]}
    assert set(got) == set(groups)
    for k, x in groups.items():
        r = got[k]
        assert (r["mean"], r["median"], r["std"], r["min"], r["max"], r["count"], r["sum"]) == pytest.approx((mean(x), median(x), pstdev(x), min(x), max(x), len(x), sum(x)), rel=1e-9)
        assert r["std_err"] == pytest.approx(stdev(x) / len(x) ** 0.5, rel=1e-9)


def test_statistics_plan(spark):
    """Bins are shuffled, and of the values only those of middle bins."""
    df = spark.range(1000).selectExpr("'t' as tokenizer", "'x' as language", "cast(id + 1 as double) as v")
    plan = M.statistics(df, df["v"], ["tokenizer"], held=True)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.split("\n") if "hashpartitioning" in line]
    assert shuffled and all("bin" in line or "__" not in line for line in shuffled)
    assert "BroadcastHashJoin" in plan
