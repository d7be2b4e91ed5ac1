"""Units, cleaning, splitting and scripts against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from lexigauge.functions import script, text
from lexigauge.functions.measure import PRESETS, Measure, n_units

TEXTS = ["", " ", "\t\n", "a b", " a  b ", "a\xa0b c\x85d", "x\x1cy\x1fz", "one. two! three?\nfour\n\nfive lines here", "日本 語", "é é", "a" * 1200 + " b", "tail\n", "«Tag» don't", "😀 😀"]


def rows(spark, *cols):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").orderBy("i")
    return [r[1:] for r in df.select("i", *cols).collect()]


def test_units(spark):
    names = ("lines", "newlines", "bytes", "characters", "words", "words_hf", "words_regex", "bytes_hf")
    got = rows(spark, *[n_units(F.col("t"), PRESETS[n]) for n in names], n_units(F.col("t"), Measure("words", include_empty=True)))
    for t, r in zip(TEXTS, got, strict=True):
        if not t:
            assert set(r) == {0}
            continue
        hf = re.findall(r"\w+|[^\w\s]+", t)
        assert r[:5] == (1, len(t.split("\n")), len(t.encode()), len(t), len(t.split())), t
        assert r[6] == len([x for x in re.split(r"\s+", t) if x.strip()]) or "\x1c" in t
        assert r[8] == len(t.split(" "))
        if "́" not in t and "\x1c" not in t:
            assert r[5] == len(hf)
            assert r[7] == len(re.sub(r"\s+", "", t).encode()) + len(hf)


def test_measure_configs():
    m = Measure.from_dict({"method": "words", "word_counting": "hf_whitespace"})
    assert (m.variant, m.unit) == ("hf_whitespace", "word")
    assert Measure.from_dict({"method": "lines", "custom_regex": ";"}).variant == "custom_regex"
    for bad in ({"method": "x"}, {"method": "words", "word_counting": "no"}, {"method": "lines", "line_counting": "custom_regex"}):
        with pytest.raises(ValueError):
            Measure.from_dict(bad)


def test_cleaning(spark):
    t = F.col("t")
    got = rows(spark, text.clean(t), text.strip(t), text.lines(t), text.paragraphs(t), text.sentences(t), text.chunks(t), text.fallback_parts(t, 3))
    for x, (clean, strip, lines, paragraphs, sentences, chunks, parts) in zip(TEXTS, got, strict=True):
        assert clean == " ".join(x.split())
        assert strip == x.strip()
        assert lines == ([p.strip() for p in x.split("\n") if len(p.strip()) >= 5] if "\n" in x else [])
        assert paragraphs == ([p.strip() for p in x.split("\n\n") if len(p.strip()) >= 5] if "\n\n" in x else [])
        assert sentences == [p.strip() for p in re.split(r"[.!?]+\s+", x) if len(p.strip()) >= 5] or "\x1c" in x
        want = ([x] if x.strip() else []) if len(x) <= 500 else [c for i in range(0, len(x), 500) if (c := x[i : i + 500].strip())]
        assert chunks == want
        assert len(parts) <= 3 and (bool(parts) or len(x.strip()) <= 5)


def test_scripts(spark):
    df = spark.createDataFrame([("Љубав и Џез, NATO Beograd x2",)], "t string")
    t = F.col("t")
    r = df.select(script.to_latin(t), script.mark_cyrillic(t), script.mark_casing(t), script.dominant_script(t), script.without_marks(script.mark_cyrillic(t)), script.to_cyrillic(F.lit("ljubav")), script.to_cyrillic(F.lit("ljubav Džez"), True), script.byte_text(F.lit("aé  b")), text.without_sentence_tags(F.lit("<s>a</s>"))).first()
    assert r[0] == "Ljubav i Džez, NATO Beograd x2"
    assert r[1] == "<csta>Ljubav i Džez,<cend> NATO Beograd x2"
    assert r[3] == "latin"
    assert r[4] == r[0]
    assert r[5:7] == ("лјубав", "љубав Џез")
    assert r[7] == "aÃ© b"
    assert r[8] == "a"
    assert "<uppe> nato<capi> beograd x2" in r[2]
