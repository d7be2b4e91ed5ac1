"""Word alignment and boundary scores."""

import random

import plain_morphology as P
import pytest
from pyspark.sql import functions as F

from lexigauge.operators import morphology as M

LEXICON = {"unhappily": ["un", "happi", "ly"], "donaudampfschifffahrt": ["donau", "dampf", "schiff", "fahrt"], "evlerindekilerden": ["ev", "ler", "in", "de", "ki", "ler", "den"]}
# Word, tokens, F1, preservation.
SCORES = [
    ("unhappily", ["un</w>", "happi</w>", "ly</w>"], 1.0, 1.0),
    ("unhappily", ["un@@", "happi@@", "ly"], 1.0, 1.0),
    ("unhappily", ["un", "##ha", "##ppi", "##ly"], 0.80, 0.67),
    ("unhappily", ["Ġunhappily"], 0.0, 0.0),
    ("unhappily", ["Ġun", "happ", "ily"], 0.50, 0.33),
    ("Donaudampfschifffahrt", ["Ġdonau", "dampf", "schiff", "fahrt"], 1.0, 1.0),
    ("evlerindekilerden", ["evler", "in", "de", "kil", "erden"], 0.60, 0.29),
]
# Text, tokens, words with their number of tokens.
WORDS = [
    ("Hello world.", ["Hello", "Ġworld", "."], [("hello", 1), ("world", 2)]),
    ("Well-being is... important, isn't it?", ["Well", "-", "being", "Ġis", "...", "Ġimportant", ",", "Ġisn", "'t", "Ġit", "?"], [("well-being", 3), ("is", 2), ("important", 2), ("isn't", 2), ("it", 2)]),
    ("Donaudampfschifffahrt", ["Donau", "dampf", "schiff", "fahrt"], [("donaudampfschifffahrt", 4)]),
    ("日本語を勉強しています", ["日本語", "を", "勉強", "して", "います"], [("日本語を勉強しています", 5)]),
    ("我爱北京天安门", ["我", "爱", "北京", "天安门"], [("我爱北京天安门", 4)]),
    ("evlerindekilerden", ["ev", "ler", "in", "de", "ki", "ler", "den"], [("evlerindekilerden", 7)]),
    ("أنا أتحدث العربية", ["أنا", "Ġأتحدث", "Ġالعربية"], [("أنا", 1), ("أتحدث", 1), ("العربية", 1)]),
]


def aligned(spark, rows):
    df = spark.createDataFrame([(i, x, t) for i, (x, t) in enumerate(rows)], "i int, text string, tokens array<string>")
    return [[(p.word, list(p.tokens)) for p in r.pairs] for r in M.aligned(df).orderBy("i").collect()]


def test_words(spark):
    for (_, _, want), got in zip(WORDS, aligned(spark, [x[:2] for x in WORDS]), strict=True):
        assert [(w, len(t)) for w, t in got] == want


def test_words_against_plain(spark):
    rng = random.Random(7)
    bits = ["Ġ", " ", "a", "Bc", ".", ",", "...", "##", "##d", "Ġ.", " !", "Ġ(", "İ", "é", "ĠĠ", "▁x", ""]
    rows = []
    for _ in range(400):
        tokens = ["".join(rng.choices(bits, k=rng.randint(1, 2))) for _ in range(rng.randint(0, 9))]
        rows.append(("".join(rng.choices([" ", "a", "Bc", ".", "\x1f", "\u00a0", "(é)", "\n"], k=rng.randint(0, 9))), tokens))
    rows += [(None, ["a"]), ("", ["a"]), ("a", []), ("  ", ["a"]), ("one two " * 3000, ["Ġone", "Ġt", "wo"] * 3000)]
    assert aligned(spark, rows) == [P.aligned(x, t) if x else [] for x, t in rows]


def scored(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, word string, tokens array<string>, morphemes array<string>")
    x = M.with_boundaries(df).withColumns(M.scores(F.col("word"), F.col("tokens"), F.col("morphemes"), F.col("gold")))
    return [{s: r[s] for s in M.SCORES} if r.boundary_f1 is not None else None for r in x.orderBy("i").collect()]


def test_scores(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, _, _) in enumerate(SCORES)], "i int, t array<string>")
    clean = {r.i: r.c for r in df.select("i", M.cleaned(F.col("t")).alias("c")).collect()}
    got = scored(spark, [(word, clean[i], LEXICON[word.lower()]) for i, (word, *_) in enumerate(SCORES)])
    for (_, _, f1, keep), s in zip(SCORES, got, strict=True):
        assert s["boundary_f1"] == pytest.approx(f1, abs=0.01)
        assert s["morpheme_preservation"] == pytest.approx(keep, abs=0.01)


def test_scores_against_plain(spark):
    """Parts that spell the word, parts that are found in it, parts that are not, empty parts, none at all."""
    rng = random.Random(9)
    rows = [("", ["a"], ["a"]), ("ab", [], ["ab"]), ("ab", ["ab"], [])]
    for _ in range(600):
        word = "".join(rng.choices("abÄé", k=rng.randint(1, 9)))

        def cut(kind, word=word):
            at = sorted(rng.sample(range(1, len(word)), rng.randint(0, min(3, len(word) - 1)))) if len(word) > 1 else []
            parts = [word[i:j] for i, j in zip([0, *at], [*at, len(word)], strict=True)]
            if kind == "some":
                parts.pop(rng.randrange(len(parts)))
            elif kind == "other":
                parts = ["".join(rng.choices("abxÄ", k=rng.randint(0, 3))) for _ in range(rng.randint(1, 5))]
            return [x.upper() if rng.random() < 0.2 else x for x in parts]

        rows.append((word, cut(rng.choice(["all", "some", "other"])), cut(rng.choice(["all", "some", "other"]))))
    branches = {"evenly" if P.spans_of(m, w, True) == P.evenly(len(w), len(m)) else "found" for w, _, m in rows if w and m}
    assert branches == {"evenly", "found"}
    for r, s in zip(rows, scored(spark, rows), strict=True):
        want = P.score(*r)
        assert (s is None) == (want is None), r
        assert want is None or s == pytest.approx(want), r


def test_cleaned(spark):
    df = spark.createDataFrame([(["Ġa", "▁b", " c", "##d", "e</w>", "f@@", "<|x|>", "[SEP]", "", "g"],)], "t array<string>")
    assert df.select(M.cleaned(F.col("t"))).first()[0] == ["a", "b", "c", "d", "e", "f", "g"]


def test_frames(spark):
    lex = spark.createDataFrame([("eng", "x", "unhappily", ["un", "happi", "ly"], 1), ("eng", "w", "unhappily", ["unhapp", "ily"], 0), ("deu", "x", "abend", ["abend"], 0)], "language string, dataset string, word string, morphemes array<string>, dataset_priority int")
    toks = spark.createDataFrame([("t", "en", 1, "Unhappily unhappily a", ["Un", "happily", "Ġun", "happi", "ly", "Ġa"]), ("t", "xx", 2, "abend", ["abend"])], "tokenizer string, language string, doc_id long, text string, tokens array<string>")
    got = {tuple(r.tokens): r for r in M.alignment(toks, lex).collect()}
    assert set(got) == {("Un", "happily"), ("un", "happi", "ly")}
    assert got[("Un", "happily")].morphemes == ["unhapp", "ily"]
    langs = M.by_language(M.alignment(toks, lex))
    assert {r["count"] for r in langs.collect()} == {2}
    s = M.summary(langs).first()
    assert (s.languages_analyzed, s.total_words_analyzed, s.boundary_f1_std_err) == (1, 2, 0.0)
    assert M.morph_score(toks, lex).first().num_samples == 2


def test_inferred():
    cases = {("happy", "happyness"): ["happy", "ness"], ("do", "undo"): ["un", "do"], ("abc", "ab"): ["ab"], ("run", "run"): ["run"], ("decide", "decision"): ["deci", "sion"], ("x", "y"): ["y"]}
    assert {k: M.inferred_morphemes(*k) for k in cases} == cases


def test_pairs_are_made_once(spark):
    """A plan must not hold the words of a text a second time, as a filter by the size of pairs would, nor the ends of tokens once a score."""
    from lexigauge.operators import morphology

    tokens = spark.createDataFrame([("t", "en", "a blue bird", ["a", " blue", " bird"]), ("t", "en", None, ["x"])], "tokenizer string, language string, text string, tokens array<string>")
    x = morphology.align_words(tokens)
    assert x._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert {(r.word, *r.tokens) for r in x.collect()} == {("blue", " blue"), ("bird", " bird")}
    lexicon = spark.createDataFrame([("en", "d", "bird", ["bi", "rd"], 0)], "language string, dataset string, word string, morphemes array<string>, dataset_priority int")
    plan = morphology.alignment(tokens, lexicon)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" AS cut#") == 1
