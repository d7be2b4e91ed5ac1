"""Nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import math
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexigauge.llm import decontam, dedup, hmm, langid, packing, pii, quality, sampling, token_files, topk, toxicity

LONG = "lorem ipsum dolor " * 20_000
ROWS = [(1, "the cat sat", "en"), (1, "the cat sat", "en"), (2, None, None), (3, "", "de"), (None, "x y z", "fr"), (4, LONG, None), (5, "   \n", "en"), (6, "\U0001f600 ; ;", "en"), (7, "the dog ran", "en"), (7, "der Hund lief", "de")]


@pytest.fixture(scope="module")
def docs(spark):
    x = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    extra = ("score", "row", "k", "n", "ids", "c", "band", "a", "b", "length", "bucket", "spans", "piece")
    return x.withColumns({c: F.lit("own") for c in extra})


@pytest.fixture(scope="module")
def none(spark, docs):
    return docs.where("1 = 0")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (7, 1, 1), (None, 1, 1), (4, None, None), (99, 0, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the cat"), (2, None), (3, ""), (None, "dog"), (1, "the cat")], "item_id long, text string")


def test_quality(docs, none, labels):
    assert quality.graded(docs, labels).count() == len(ROWS)
    assert quality.selected(docs, labels).columns == docs.columns
    assert quality.graded(none, labels).count() == 0
    assert {r.kept for r in quality.graded(docs, labels.where("1 = 0")).collect()} == {True}


def test_decontamination(docs, none, bench):
    got = [(r.doc_id, r.n_words, r.n_hit, r.contaminated) for r in decontam.digest(docs, bench).collect()]
    assert got.count((1, 3, 2, True)) == 2 and (2, 0, 0, False) in got and (3, 0, 0, False) in got and (None, 3, 0, False) in got
    assert decontam.digest(none, bench).count() == 0
    assert decontam.digest(docs, bench.where("1 = 0")).where("contaminated").count() == 0
    assert decontam.clean(docs, bench).columns == docs.columns


def test_decontamination_null_item(spark):
    d = spark.createDataFrame([(1, "x one two three y"), (2, "four five"), (3, "no")], "doc_id long, text string")
    b = spark.createDataFrame([(None, "one two three"), (None, "four five"), (7, "two three"), (8, None)], "item_id long, text string")
    rows = {r.doc_id: r for r in decontam.digest(d, b).collect()}
    digest = lambda x: hashlib.sha256(x).hexdigest()
    # as in the SQL: a null id is counted once and is not in the list
    assert [(r.n_hit, r.n_items, r.items_sha256, r.contaminated) for _, r in sorted(rows.items())] == [(3, 2, digest(b"7"), True), (2, 1, digest(b""), True), (0, 0, digest(b""), False)]
    assert {r.doc_id for r in decontam.clean(d, b).collect()} == {3}
    parts = {r.doc_id: r for r in decontam.contamination(d, b, max_bytes=8).collect()}
    assert [(parts[i]["__lx_n_hit"], parts[i]["__lx_n_items"]) for i in (1, 2, 3)] == [(3, 2), (2, 1), (0, 0)]


def test_packing(docs, none):
    rows = packing.packed(docs).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, None, 4, 5, 6, 7}
    assert [r.length for r in rows if r.doc_id in (2, 3)] == [1, 1]
    assert sum(r.piece == 0 for r in rows) == len(ROWS)
    assert packing.packed(none).count() == 0


def test_language(docs, none):
    m = langid.fit(docs)
    rows = langid.predicted(docs.select("doc_id", "text"), m).collect()
    assert [r["__lx_lang_pred"] for r in rows if r.text is None or r.text in ("", "   \n", "\U0001f600 ; ;")] == ["und"] * 4
    assert langid.predicted(none, langid.fit(none)).count() == 0
    assert {r["__lx_lang_pred"] for r in langid.predicted(docs, langid.fit(none)).collect()} == {"und"}


def test_language_rare(spark):
    hot = [(i, f"alpha beta gamma w{i % 50} w{i % 49}x", "hot") for i in range(2000)]
    d = spark.createDataFrame([*hot, *((5000 + i, "omega psi chi", "rare") for i in range(3)), (9000, None, "silent"), (9001, "tau", None)], "doc_id long, text string, lang string")
    m = langid.fit(d, sample=100)
    assert m.langs == ["hot", "rare"]  # of a language without texts nothing is learned
    assert {"omega", "psi", "chi", "alpha", "beta", "gamma"} <= set(m.tables[0][0]) and "tau" not in m.tables[0][0]
    asked = spark.createDataFrame([(1, "psi omega"), (2, "gamma beta")], "doc_id long, text string")
    assert [r["__lx_lang_pred"] for r in langid.predicted(asked, m).orderBy("doc_id").collect()] == ["rare", "hot"]


def test_samples_are_of_rows(spark):
    """One id, or none, on all rows: a sample is bounded all the same."""
    d = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"))
    assert 50 < sampling.bounded(d, 200).count() < 400
    assert 50 < sampling.bounded_each(d, "lang", 200).count() < 400
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    same = d.withColumn("doc_id", F.lit(7).cast("long"))
    assert 50 < sampling.labelled(same, labels, "doc_id", "text", "quality", 200).count() < 400
    many = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 20 == 0).cast("int").alias("toxic"))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = sampling.labelled(docs, many, "doc_id", "text", "toxic", 400, balanced=True).collect()
    toxic = [r for r in got if r["__lx_y"] == 1]
    assert len(toxic) == 200 and 120 < len(got) - len(toxic) < 300
    assert abs(sum(r["__lx_weight"] for r in got) - 4000) < 1200


def test_near_duplicates(docs, none):
    rows = dedup.near_duplicates(docs, size=3, num=85).collect()
    by = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in rows}
    assert len(rows) == len(ROWS)
    assert by[1, 1] == (1, True) and by[2, 0] == (2, True) and by[3, 0] == (3, True) and by[None, 1] == (None, True)
    assert dedup.near_duplicates(none).count() == 0
    kept = dedup.distinct_documents(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 1


def test_distinct_documents_repeated_ids(spark):
    a, b, c, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abce")
    near = c + " more"
    rows = [(1, a, 0), (2, b, 1), (2, a, 2), (None, c, 3), (None, near, 4), (5, e, 5), (5, e + " more", 6), (5, e.upper(), 7), (6, "", 8), (6, "", 9), (9, b, 10), (None, a, 11)]
    kept = dedup.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string, row int"))
    assert kept.columns == ["doc_id", "text", "row"]
    groups = [{0, 2, 11}, {1, 10}, {3, 4}, {5, 6, 7}, {8, 9}]
    got = [r.row for r in kept.collect()]
    assert sorted(next(i for i, g in enumerate(groups) if r in g) for r in got) == [0, 1, 2, 3, 4]
    assert 0 in got and 1 in got


def test_language_model(docs, none):
    x = docs.select("doc_id", "text")
    counts = hmm.counted(x.select("text"))
    rows = hmm.scored(x, hmm.train(x, counts, passes=1), counts).collect()
    assert len(rows) == len(ROWS) and all(r.score <= 0 and r.n_known == r.n_tokens for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 5)} == {1}
    assert hmm.digest(none).count() == 0


def test_language_model_without_training(spark):
    """Every document held out: scores are finite, and each token is as likely as the unseen one."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    d = spark.createDataFrame([(i, "a b a") for i in ids], "doc_id long, text string")
    rows = hmm.digest(d).collect()
    assert len(rows) == 3 and all(math.isfinite(r.score) and r.score <= 0 and r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in rows)


def test_language_model_long_words(spark):
    """Words of any length are known by what they are, and are counted once however often they occur."""
    long = "x" * 100_000
    d = spark.createDataFrame([(1, f"{long} a {long}"), (1, f"{long}y"), (3, "a")], "doc_id long, text string")
    counts = hmm.counted(d.select("text"))
    assert {r.c for r in counts.where(F.length("token") > 30).collect()} == {2, 1}
    rows = hmm.scored(d, hmm.train(d, counts, passes=1), counts).collect()
    assert all(r.n_known == r.n_tokens and math.isfinite(r.score) for r in rows)


def test_top_k(spark):
    d = spark.createDataFrame([(None, [1.0]), (20, [1.0, 0.5]), (20, [1.0, 0.5]), (1, None), (2, []), (3, [2.0]), (4, [2.0])], "vec_id long, embedding array<double>")
    d = d.withColumns({c: F.lit("own") for c in ("id", "v", "a", "salt", "score", "rank", "chunk")})
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in topk.digest(d).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 3, 64 * 128), (20, 2, 4, 64 * 128), (20, 3, 2, 0)]
    assert topk.digest(d.where("1 = 0")).count() == 0 and topk.digest(d.where("vec_id < 5")).count() == 0


def test_personal_data(docs, none):
    assert pii.digest(docs).where("spans <> ''").count() == 0
    r = pii.redacted(docs)
    assert r.columns == docs.columns and r.where("text is null").count() == 1
    assert pii.digest(none).count() == 0


def test_redaction(spark):
    d = spark.createDataFrame([(1, "a@b.com 10.0.0.1 +1 (234) 555-1234, 4111 1111 1111 1111!"), (2, "x\U0001f600 a@b.com")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redacted(d).collect()} == {1: "[email] [ip] [phone], [card]!", 2: "x\U0001f600 [email]"}


def test_token_files(docs, none, tmp_path, spark):
    rows = sorted(token_files.round_trip(docs).collect(), key=lambda r: r.start)
    assert len(rows) == len(ROWS) and rows[0].doc_id is None
    assert all(b.start == a.start + a.n_tokens for a, b in zip(rows, rows[1:], strict=False))
    assert token_files.round_trip(none).count() == 0
    for e in ("delta", "dictionary"):
        token_files.write_tokens(docs, str(tmp_path / e), encoding=e, partitions=2)
        assert token_files.read_tokens(spark, str(tmp_path / e)).count() == len(ROWS)
    with pytest.raises(ValueError):
        token_files.write_tokens(docs, str(tmp_path / "x"), encoding="none")


def test_toxicity(docs, none, labels):
    assert toxicity.digest(docs, labels).count() == len(ROWS)
    assert toxicity.digest(none, labels).count() == 0
    assert {r.predicted for r in toxicity.digest(docs, labels.where("1 = 0")).collect()} == {0}


def test_stages(spark, docs, none, tmp_path, labels, bench):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for d in (docs, none):
        for name, f in corpus_pipeline.STAGES[:-1]:
            assert f(spark, d, str(tmp_path)).columns == docs.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, d, str(tmp_path)).count() >= 0
