"""Sources, analyzer, reports, command line and training helpers."""

import json
from pathlib import Path
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lexigauge.cli import main
from lexigauge.operators import training
from lexigauge.operators.encode import tokenizer
from lexigauge.plans import figures, report
from lexigauge.plans.analyzer import METRICS, Analyzer, register_metric
from lexigauge.sources import corpus as S
from lexigauge.sources.sinks import write_cache, write_examples, write_training


@pytest.fixture(scope="module")
def files(tmp_path_factory, spark):
    d = tmp_path_factory.mktemp("corpus")
    (d / "en").mkdir()
    (d / "en" / "a.json").write_text(json.dumps([{"text": " one two "}, {"text": ""}, {"text": "three"}]))
    (d / "en" / "b.txt").write_text("four  five\n\nsix\n")
    (d / "de.jsonl").write_text('{"text": "eins zwei"}\nbad\n{"text": "drei"}\n')
    spark.createDataFrame([("un deux",), (None,), ("nan",), (" trois ",)], "content string").write.parquet(str(d / "fr.parquet"))
    return d


def test_corpus(spark, files):
    meta = S.LanguageMetadata({"languages": {"en": {"data_path": str(files / "en")}, "de": str(files / "de.jsonl"), "fr": {"data_path": str(files / "fr.parquet")}, "xx": {"data_path": str(files / "none")}}, "analysis_groups": {"script_families": {"a": ["en", "de"], "b": ["fr"]}}})
    got = {}
    for r in S.read_corpus(spark, meta, None).collect():
        got.setdefault(r.language, []).append(r.text)
    assert {k: sorted(v) for k, v in got.items()} == {"en": ["", "four five", "one two", "six", "three"], "de": ["drei", "eins zwei"], "fr": ["trois", "un deux"]}
    assert S.read_corpus(spark, meta, 2).where("language = 'en'").count() == 2
    assert {r.language for r in S.read_corpus(spark, meta, None, ("script_family", "b")).collect()} == {"fr"}
    assert meta.statistics() == {"script_families": {"a": 2, "b": 1}} and meta.groups_of("de", "script_families") == ["a"]
    with pytest.raises(ValueError):
        S.LanguageMetadata({"languages": {}, "analysis_groups": {"t": {"g": ["zz"]}}})


def test_tokenized(spark, tmp_path):
    rec = {"tokenizer_name": "t", "language": "en", "tokens": [1, 2], "text": "a b", "metadata": {"s": "x"}}
    (tmp_path / "flat.json").write_text(json.dumps([rec, rec]))
    (tmp_path / "keyed.json").write_text(json.dumps({"u": [rec]}))
    assert S.read_tokenized(spark, str(tmp_path / "flat.json")).count() == 2
    assert S.read_tokenized(spark, str(tmp_path / "keyed.json")).first().tokenizer == "u"
    with pytest.raises(ValueError):
        S.read_tokenized(spark, "x.pkl")
    (tmp_path / "v.txt").write_text("a\n\nb\n")
    assert S.read_vocabulary(str(tmp_path / "v.txt"), "t") == {"a": 0, "b": 1}


def test_lexicons(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("# c\nUnhappy\tun-happy\n")
    (tmp_path / "m.csv").write_text("Word,MorphoLexSegm\ncats,cat+s\nx,\n")
    (tmp_path / "n.tsv").write_text("deu\tlesbar\tlesen→lesbar:ADJ\nbad line\n")
    (tmp_path / "d.json").write_text(json.dumps([{"word": "Haustür", "morphemes": ["haus", "tür"]}]))
    got = {(r.language, r.word): (r.morphemes, r.dataset_priority) for r in S.read_lexicons(spark, {"ladec": str(tmp_path / "l.tsv"), "morpholex": str(tmp_path / "m.csv"), "morphynet": str(tmp_path / "n.tsv"), "dagobert": str(tmp_path / "d.json")}).collect()}
    assert got == {("en", "unhappy"): (["un", "happy"], 0), ("en", "cats"): (["cat", "s"], 1), ("deu", "lesbar"): (["les", "bar"], 2), ("de", "haustür"): (["haus", "tür"], 3)}


@pytest.fixture(scope="module")
def analysed(spark):
    docs = spark.createDataFrame([(1, "en", "unhappily the cat"), (2, "en", "a dog"), (3, "de", "der hund bellt")], "doc_id long, language string, text string")
    lex = spark.createDataFrame([("en", "x", "unhappily", ["un", "happi", "ly"], 0)], "language string, dataset string, word string, morphemes array<string>, dataset_priority int")
    groups = spark.createDataFrame([("family", "west", "en"), ("family", "west", "de")], "group_type string, group_name string, language string")
    a = Analyzer.of_corpus(docs, [tokenizer("whitespace"), tokenizer("char")], lexicon=lex, groups=groups)
    r = a.results()
    a.close()
    return r


def test_results(analysed, tmp_path):
    assert set(analysed["fertility"]["per_tokenizer"]) == {"whitespace", "char"}
    assert analysed["fertility"]["pairwise_comparisons"]["char_vs_whitespace"]["tokenizer_1"] == "char"
    assert analysed["renyi_efficiency"]["per_tokenizer"]["char"]["renyi_1.0"]["overall"] > 0
    assert analysed["grouped_analysis"]["family"]["west"]["tokenizer_fairness_gini"]["per_tokenizer"]["char"]["num_languages"] == 2
    assert analysed["morphological_alignment"]["summary"]["whitespace"]["total_words_analyzed"] == 1
    report.write_json(analysed, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["token_length"]
    names = ["whitespace", "char"]
    made = report.write_tables(analysed, names, str(tmp_path), {"own": {"metrics": ["fertility"], "caption": "C", "label": "l"}})
    assert any("own" in m for m in made) and "\\caption{C}" in (tmp_path / "own_table.tex").read_text()
    d = report.plot_data(analysed, names)
    assert d["lorenz"]["char"]["x"][0] == 0.0
    made = {Path(p).stem: Path(p).read_text() for p in figures.draw(d, names, str(tmp_path / "p"), {"char": "Characters <1>"})}
    assert {"fertility", "lorenz_curves", "fertility_by_language", "fertility_faceted", "family_fertility", "morphological_alignment"} <= set(made)
    for svg in made.values():
        ElementTree.fromstring(svg)
    assert "Characters &lt;1&gt;" in made["fertility"] and made["lorenz_curves"].count("<polyline") == 2 and made["fertility_by_language"].count("<rect") == 1 + 4 + 2
    assert "whitespace" in report.summary_text(analysed, names)
    assert "whitespace: boundary F1" in report.morphology_text(analysed, names)
    assert report.analysis_summary(analysed, names)["languages"] == ["de", "en"]
    assert analysed["grouped_analysis"]["family"]["west"]["morphological_alignment"]["summary"]["whitespace"]["total_words_analyzed"] == 1


def test_table_layout():
    r = {"fertility": {"per_tokenizer": {"a_b": {"global": {"mean": 0.25, "std_err": 0.01}}, "c": {"global": {"mean": 0.5, "std_err": None}}}}, "vocabulary_utilization": {"per_tokenizer": {"a_b": {"global_utilization": 0.5}}}}
    assert report.table(r, ["a_b", "c"], ["fertility", "vocabulary_utilization"]).split("\n") == [
        "% Requires \\usepackage{makecell} in preamble",
        "\\begin{tabular}{lcc}",
        "\\toprule",
        "Tokenizer & Fertility & \\makecell{Vocab \\\\ Utilization} \\\\",
        "\\midrule",
        "a\\_b & \\textbf{0.250 {\\scriptsize $\\pm$ 0.010}} & \\textbf{50.0\\%} \\\\",
        "c & 0.500 & --- \\\\",
        "\\bottomrule",
        "\\end{tabular}",
    ]
    with pytest.raises(ValueError):
        report.table(r, ["c"], ["none"])


def test_slim():
    assert len(report.slim({"a": list(range(1000)), "values": [1]})["a"]) == 50


def test_command_line(tmp_path):
    out = main(["--documents", "/root/testdata/sf0.001/documents.parquet", "--output-dir", str(tmp_path), "--save-full-results", "--quiet"])
    assert set(out["fertility"]["per_tokenizer"]) == {"word_punct", "whitespace"}
    assert (tmp_path / "analysis_results.json").exists() and (tmp_path / "latex_tables" / "basic_metrics_table.tex").exists()
    with pytest.raises(SystemExit):
        main(["--quiet"])
    assert main(["--create-sample-configs", str(tmp_path / "c")])["written"] == ["languages.json", "measure.json", "morphology.json", "tables.json", "tokenizers.json"]
    assert S.LanguageMetadata(str(tmp_path / "c" / "languages.json")).group_members("script_family", "latin") == ["en", "de"]


def test_stored_tokenizer_morphology(spark):
    """Ids are spelled before they meet morphemes; counts get their strings by the vocabulary."""
    import public_tokenizers as P

    docs = spark.createDataFrame([(1, "en", "eating mention")], "doc_id long, language string, text string")
    lex = spark.createDataFrame([("en", "x", "eating", ["eat", "ing"], 0), ("en", "x", "mention", ["men", "tion"], 0)], "language string, dataset string, word string, morphemes array<string>, dataset_priority int")
    a = Analyzer.of_corpus(docs, [tokenizer("huggingface", name="bpe", path=P.path("byte_bpe_50k.json")), tokenizer("whitespace")], lexicon=lex)
    got = {(r.tokenizer, r.word): r.tokens for r in a.aligned().collect()}
    assert "".join(got["bpe", "eating"]) == "eating" and "".join(got["bpe", "mention"]) == "mention"
    named = {r.token: r.token_id for r in a.spelled_counts().where("tokenizer = 'bpe'").collect()}
    assert named["Ġmention"] == 3068 and all(i is not None for i in named.values())
    a.close()


def test_median_and_plugins(spark):
    from lexigauge.operators import metrics as M

    rows = [("t", "en", float(x)) for x in (3, 1, 2, 2)] + [("t", "de", float(x)) for x in (0, 5, 9)] + [("u", None, 7.0)]
    df = spark.createDataFrame(rows, "tokenizer string, language string, v double")
    got = {(r.tokenizer, r.language, r["count"]): (r.median, r.mean, r["min"], r["max"], r["std_err"]) for r in M.statistics(df, F.col("v"), ["tokenizer"]).collect()}
    assert got["t", "en", 4][:2] == (2.0, 2.0) and got["t", "de", 3][0] == 5.0 and got["t", None, 7][0] == 2.0
    assert got["u", None, 1] == (7.0, 7.0, 7.0, 7.0, None)
    register_metric("texts", lambda f, keys: f.docs.groupBy(*keys).agg(F.count("*").alias("n")))
    try:
        docs = spark.createDataFrame([(1, "en", "a b")], "doc_id long, language string, text string")
        assert Analyzer.of_corpus(docs, [tokenizer("char")]).results()["texts"]["per_tokenizer"]["char"] == [{"n": 1}]
    finally:
        METRICS.clear()


def test_mixed(spark):
    docs = spark.createDataFrame([(1, "en", "a b")], "doc_id long, language string, text string")
    toks = spark.createDataFrame([("ids", "en", "1", None, ["1", "5"])], "tokenizer string, language string, doc_id string, text string, tokens array<string>")
    a = Analyzer.mixed(docs, [tokenizer("char")], toks)
    assert "mixed_gini" not in a.register_views("mixed_")
    assert spark.sql("select sum(cnt) from mixed_token_counts").first()[0] == 5
    assert a.results()["vocabulary_utilization"]["per_tokenizer"]["ids"]["global_vocab_size"] == 6
    with pytest.raises(ValueError):
        Analyzer.mixed(docs, [tokenizer("char", name="ids")], toks)


def test_training(spark, tmp_path):
    tok = spark.createDataFrame([(["a", "b", "cd", "e", "Ġ", "f"],), (["x"],), ([],)], "t array<string>")
    assert [r[0] for r in tok.select(training.merged_runs(F.col("t"))).collect()] == [["ab", "eĠ"], [], []]
    docs = spark.createDataFrame([("b a b",), ("b  c",), ("<s>q</s>",), ("",)], "text string")
    assert {r.word: r.cnt for r in training.word_counts(docs).collect()} == {"b": 3, "a": 1, "c": 1, "<s>q</s>": 1}
    w = training.word_counts(docs)
    assert training.top(w, 1, "word").first().word == "b"
    chars = F.split("word", "")
    assert training.token_frequency(w, chars).where("token = 'b'").first().cnt == 3
    assert training.run_counts(w, chars).where("seq = '<s>q</s>'").first().cnt == 1
    assert training.extended_vocabulary({"a": 0, "b": 1, "c": 2}, ["b", "x", "y"], 4, cutoff=2) == {"a": 0, "b": 1, "x": 2, "y": 3}
    sweep = {r.cutoff: r.entropy for r in training.cutoff_sweep(training.token_frequency(w, F.array("word")), [1, 2]).collect()}
    assert sweep[1] == 0.0 and sweep[2] > 0
    s = S.training_set(docs, "set")
    a, b = S.split(s)
    assert a.count() + b.count() == s.count() == 3
    write_training(a, b, str(tmp_path / "train"))
    t = training.train_bpe(docs, 300)
    assert t.encode("b a").ids
    assert training.train_bpe(docs, 300, end_suffix="Ġ").get_vocab_size() > 256


def library_bpe(texts, size):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    t = Tokenizer(models.BPE(unk_token="<unk>"))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    t.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=size, special_tokens=["<unk>"], initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    return t


def test_training_is_the_library(spark):
    """Counts beyond 1000 keep their proportions; runs of spaces count, too."""
    texts = ["cd " * 3000 + "ab " * 1500 + "aaaa  abab\n\n  cdcdcd xyz" * 7, None, "", "abcabc bcbc aab " * 50]
    docs = spark.createDataFrame([(x,) for x in texts], "text string")
    for size in (258, 262, 300):
        got, want = (json.loads(t.to_str()) for t in (training.train_bpe(docs, size), library_bpe([x for x in texts if x], size)))
        assert got["model"]["merges"] == want["model"]["merges"]
        assert got["model"]["vocab"] == want["model"]["vocab"] and got["added_tokens"] == want["added_tokens"]
    corpus = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    got, want = (json.loads(t.to_str())["model"] for t in (training.train_bpe(corpus, 2000), library_bpe([r.text for r in corpus.collect()], 2000)))
    assert got["merges"] == want["merges"] and got["vocab"] == want["vocab"]


def test_sinks(spark, tmp_path):
    x = spark.createDataFrame([("char", "en", 1, "ab", ["a", "b"])], "tokenizer string, language string, doc_id long, text string, tokens array<string>")
    t = tokenizer("pretokenized", name="char", vocab={"b": 1, "a": 0})
    assert write_cache(x, [t], str(tmp_path))["char"].endswith("char_vocab.txt")
    assert (tmp_path / "char_vocab.txt").read_text() == "a\nb"
    assert spark.read.parquet(str(tmp_path / "tokens")).count() == 1
    write_examples(x.withColumn("word", F.lit("ab")).withColumn("morphemes", F.array(F.lit("ab"))), str(tmp_path / "ex"))
    assert spark.read.text(str(tmp_path / "ex")).first().value == "en\tab\ta b\tab"
