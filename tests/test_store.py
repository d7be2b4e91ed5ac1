"""Stored facts, sketches, and rules that are counted in passing."""

import pytest
from pyspark.sql import functions as F

from lexigauge.operators import metrics as M
from lexigauge.operators import sketches
from lexigauge.operators.encode import encode, tokenizer, tokenizers_table
from lexigauge.operators.facts import facts, with_groups
from lexigauge.operators.validate import Watch, violations
from lexigauge.plans.analyzer import Analyzer
from lexigauge.plans.store import FactStore, shared_tokens, side_by_side

TOKENIZERS = ("whitespace", "word_punct")


@pytest.fixture(scope="module")
def tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.col("lang").alias("language"), "text")
    return encode(docs, [tokenizer(t) for t in TOKENIZERS])


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_store(spark, tokens, tmp_path):
    made = facts(tokens, tokenizers_table(spark, [tokenizer(t) for t in TOKENIZERS]))
    store = FactStore(spark, str(tmp_path), "test")
    got = store.save("native", made, 4)
    assert store.names() == ["native"]
    assert rows(got.docs) == rows(made.docs) and rows(got.counts) == rows(made.counts) and rows(got.tokenizers) == rows(made.tokenizers)
    assert rows(M.type_token_ratio(store.load("native"))) == rows(M.type_token_ratio(made))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for f in (side_by_side, shared_tokens):
            plan = executed(f(got, *TOKENIZERS))
            # neither the texts are read nor anything is shuffled
            assert "Exchange" not in plan and "regexp" not in plan and "SortMergeJoin" in plan
            assert rows(f(got, *TOKENIZERS)) == rows(f(made, *TOKENIZERS))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    store.save("native", made, 2)
    assert rows(store.load("native").docs) == rows(made.docs)
    store.drop("native")
    assert store.names() == []


def test_sketches(spark, tokens):
    """Unions are the sketches of what they are made of, and estimates keep their error."""
    one = sketches.type_sketches(tokens)
    exact = {(r.tokenizer, r.language, r.pooled): r for r in M.type_token_ratio(facts(tokens)).collect()}
    got = sketches.rolled_up(one).collect()
    assert len(got) == len(exact)
    for r in got:
        x = exact[r.tokenizer, r.language, r.pooled]
        assert r.tokens == x.tokens and r.types == pytest.approx(x.types, rel=4 * sketches.relative_error(), abs=1)
    groups = spark.createDataFrame([("f", "all", x) for x in ("de", "en", "es", "fr")] + [("f", "one", "de")], "group_type string, group_name string, language string")
    every = {(r.tokenizer, r.group_name): r.types for r in sketches.rolled_up(with_groups(one, groups), ("tokenizer", "group_type", "group_name")).where("pooled").collect()}
    pooled = {r.tokenizer: r.types for r in got if r.pooled}
    for t in TOKENIZERS:
        assert every[t, "all"] == pooled[t] and every[t, "one"] == next(r.types for r in got if r.language == "de" and r.tokenizer == t)


BAD = [("t", "en", 1, "ab", ["1", "-2", "9"]), ("u", "", 2, None, []), ("t", "en", 3, "abcdef", ["1"])]


def test_watch(spark):
    bad = spark.createDataFrame(BAD, "tokenizer string, language string, doc_id long, text string, tokens array<string>")
    sizes = spark.createDataFrame([("t", 5, None)], "tokenizer string, vocab_size long, unk_id int")
    w = Watch(bad, sizes, ["en"])
    assert w.frame.columns == bad.columns and w.frame.count() == 3
    assert {(rule, n) for _, rule, n, _ in w.found()} == {(r.rule, r.n) for r in violations(bad, sizes, ["en"]).collect()}
    with pytest.raises(ValueError, match=r"u: no_language \(1\)"):
        w.check()
    with pytest.raises(ValueError, match="no_tokens"):
        Analyzer(bad, sizes, strict=True)
    good = Analyzer(bad.where("doc_id = 3"), sizes, strict=True)
    assert good.facts.docs.count() == 1
    good.close()


def test_strict_reads_once(spark):
    """Checking and facts come from one pass over the texts."""
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    counted = F.udf(count, "string").asNondeterministic()  # else it may be copied into a filter
    docs = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("en").alias("language"), counted(F.lit("a b")).alias("text"))
    a = Analyzer.of_corpus(docs, [tokenizer("whitespace")], strict=True)
    assert seen.value == 20
    a.close()
