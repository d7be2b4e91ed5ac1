"""Tokenizers from files: ids of fixed texts as their libraries give them, sizes, decoding."""

from pyspark.sql import functions as F

from lexigauge.operators.encode import encode, tokenizers_table
from lexigauge.plans.probes import from_files

# Texts with the ids and strings that the libraries give for them (tokenizers, tiktoken, sentencepiece).
PROBE = ["The nation was eating, then thinking.", "Die Einheit (1990) blieb.", "naïve café – 東京!", "  two  spaces\nline", "don't stop: 3.14", "el estado mention"]
IDS = [
    ("byte_bpe", 0, "464,3277,373,6600,11,788,3612,13"),
    ("byte_bpe", 1, "32423,412,259,29361,357,19891,8,698,494,65,13"),
    ("byte_bpe", 2, "2616,38776,40304,784,10545,251,109,12859,105,0"),
    ("byte_bpe", 3, "220,734,220,9029,198,1370"),
    ("byte_bpe", 4, "9099,470,2245,25,513,13,1415"),
    ("byte_bpe", 5, "417,1556,4533,3068"),
    ("word_bpe", 0, "518,2670,739,4371,267,1594,3291,269"),
    ("word_bpe", 1, "2082,29944,37255,263,272,280,280,271,264,1450,8677,269"),
    ("word_bpe", 2, "1097,35689,563,15304,1224,48338,21078,361,256"),
    ("word_bpe", 3, "1237,9006,1148"),
    ("word_bpe", 4, "847,713,1691,281,274,269,272,275"),
    ("word_bpe", 5, "832,2291,2933,6762"),
    ("multi", 0, "2278,4790,390,3936,11,550,1953,13"),
    ("multi", 1, "29928,6391,8480,522,3405,7771,8,888,414,65,13"),
    ("multi", 2, "629,15487,303,25118,1662,220,18413,31375,0"),
    ("multi", 3, "220,732,220,7673,198,1889"),
    ("multi", 4, "13966,380,1590,25,805,13,7271"),
    ("multi", 5, "338,18372,2152"),
    ("piece_bpe", 0, "415,5878,403,8652,28725,868,4195,28723"),
    ("piece_bpe", 1, "2941,6004,12307,325,28740,28774,28774,28734,28731,843,25295,28723"),
    ("piece_bpe", 2, "1879,28920,333,28345,764,28705,30366,29936,28808"),
    ("piece_bpe", 3, "259,989,28705,10599,13,1081"),
    ("piece_bpe", 4, "949,28742,28707,2115,28747,28705,28770,28723,28740,28781"),
    ("piece_bpe", 5, "639,17865,4389"),
]


def test_ids(spark):
    df = spark.createDataFrame(list(enumerate(PROBE)), "doc_id long, text string").withColumn("language", F.lit("xx"))
    got = {(r.tokenizer, r.doc_id): ",".join(r.tokens) for r in encode(df, from_files()).collect()}
    assert got == {(t, i): ids for t, i, ids in IDS}
    for t in from_files():
        if t.name != "word_bpe":
            assert [r[0] for r in df.orderBy("doc_id").select(t.decode(t.encode(F.col("text")))).collect()] == PROBE


def test_sizes(spark):
    got = {r.tokenizer: (r.vocab_size, r.unk_id) for r in tokenizers_table(spark, from_files()).collect()}
    assert got == {"byte_bpe": (50257, None), "word_bpe": (49408, None), "multi": (50256, None), "piece_bpe": (32000, 0)}


def test_portions_and_pieces(spark):
    """Texts are given to a library in portions; ids put together from pieces are those of whole texts."""
    import public_tokenizers as P

    from lexigauge.operators import encode as E

    texts = [*PROBE, "a  b", " x  y \n z", "é ̀ é", "don't  'S I'LL", "<|endoftext|> a <|endoftext|>", "", "   ", "a\x1c b\x85 c\xa0 d", "日本 語 a", " ´ ¨ á ́b"]
    assert [x for few in E.portions([*texts, None], 5) for x in few] == texts and max(map(len, E.portions(texts, 5))) < len(texts)
    path = P.path("byte_bpe_50k.json")
    whole = lambda xs: [e.ids for e in E._hf(path).encode_batch(xs)]
    known = {}
    assert [x.tolist() for x in E.by_pieces(whole, E.BEFORE_SPACE, known)(texts)] == whole(texts) and " then" in known


def test_stored_ids_of_all_tokenizers(spark):
    from lexigauge.plans.probes import stored_ids

    got = stored_ids(spark, "/root/testdata/sf0.001")
    assert {r[0] for r in got.select("tokenizer").distinct().collect()} == {t.name for t in from_files()}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_stated_error_is_that_of_merged_sketches():
    from lexigauge.operators import sketches

    assert abs(sketches.relative_error(12) - 1.04 / 64) < 1e-12


def test_parts_make_up_texts():
    """Ids and decoded texts put together from parts are those of whole texts, for every tokenizer from a file; a part is encoded once."""
    import random

    from lexigauge.operators import parts as E

    made = random.Random(5)
    bits = [*" \n\t.,'!(<|", "  ", " \n", "\n\n", "\x1c", "\x85", "\xa0", "　", "́", "´", "µ", "ß", "É", "é", "ÿ", "ɏ", "Σ", "日本", "😀", "the", "word", "'s", "'ll", "12", "▁", "▁a", "<s>", "</s>", "<|endoftext|>", "̀x", "ﬁ"]
    texts = [*PROBE, "", " ", "  ", "\n", " a", "\na", "a ", "a\n", "a \nb", "a\n b", "a \n\nb", "a\x1c b", *["".join(made.choices(bits, k=made.randint(1, 14))) for _ in range(3000)], *[" ".join(made.choices(["the", "word.", "été", "12", "\nnew", "line"], k=9)) for _ in range(300)]]
    ts = from_files()
    kept = E.Parts([t.parts for t in ts])
    for batch in (texts, texts[::-1]):
        for t, (ids, n) in zip(ts, kept.encode(batch), strict=True):
            upto = n.cumsum()
            got = [ids[j - k : j].tolist() for j, k in zip(upto, n, strict=True)]
            wrong = [(t.name, x, a, list(b)) for x, a, b in zip(batch, got, t.ids(batch), strict=True) if a != list(b)]
            assert not wrong, wrong[:3]
    seen = []
    kept = E.Parts([lambda parts, begins: seen.extend(parts) or [[0]] * len(parts)])
    for _ in range(2):
        assert kept.encode(["one two two", "two one two"])[0][1].tolist() == [3, 3]
    assert sorted(seen) == [" one", " two", "one", "two"]


def test_facts_leave_workers_without_ids(spark):
    """Facts made in the workers are those of encoded tokens, null languages and blank texts too, and no list of ids reaches Spark."""
    from lexigauge.functions.measure import PRESETS
    from lexigauge.operators.facts import facts
    from lexigauge.operators.library_facts import library_facts, numbers
    from lexigauge.plans.queries import stored_utilization

    rows = [(i, [None, "de", "en"][i % 3], x) for i, x in enumerate([*PROBE, None, "", " \n", "a", *PROBE])]
    docs = spark.createDataFrame(rows, "doc_id long, language string, text string")
    ts = from_files()
    for measure in (PRESETS["words"], PRESETS["bytes"]):
        want, got = facts(encode(docs, ts), None, measure), library_facts(docs, ts, None, measure)
        for a, b in ((want.docs, got.docs), (want.counts, got.counts)):
            assert a.dtypes == b.dtypes and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    most = {(r.doc_id, t.tokenizer): t.most for r in numbers(docs, ts, "doc_id").collect() for t in r.by}
    assert most == {(r.doc_id, r.tokenizer): max(map(int, r.tokens)) for r in encode(docs, ts).collect()}
    plan = stored_utilization(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "cast(ids" not in plan and "array<int>" not in plan and "Generate" not in plan
