"""Cross-tokenizer alignment against a plain alignment of whole texts."""

import bisect
import collections
import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexigauge.llm import alignment
from lexigauge.llm import queries as Q
from lexigauge.llm.common import table

SF = "/root/testdata/sf0.001"
PARTS = [*"ab .,\n\t\r\x00\x1cé中▁", "  ", "ñ", "ß", "<s>", "<unk>", "<|endoftext|>", "<0x41>", "The", "ing", "'s", "1", "23", "\xa0", "　", "\U0001f600", "ﬁ", "é", "ª", " hello", " Wörter", "\nNext", "\n\n", " \n", "***"]


@pytest.fixture(scope="module")
def plain():
    """text -> ids of both, linked pairs of ids, groups as text; None without tokens."""
    t = Tokenizer.from_file(alignment.default_tokenizer())
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    byte = {c: b for b, c in alignment.byte_chars().items()}

    def run(text):
        if not text:
            return None
        a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text, num_threads=1)
        shown = [bytes(byte[c] for c in t.id_to_token(i)) for i in a], [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
        if any(b"".join(x) != (" " + text).encode() for x in shown):
            return None
        spans = [[], []]
        for x, own in zip(shown, spans, strict=True):
            at = 0
            for y in x:
                own.append((at, at := at + len(y)))
        starts = [s for s, _ in spans[1]]
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j in range(bisect.bisect_right(starts, s) - 1, bisect.bisect_left(starts, e))]
        cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = [([], []) for _ in cuts]
        for k, ids in ((0, a), (1, b)):
            for (_, e), i in zip(spans[k], ids, strict=True):
                groups[bisect.bisect_left(cuts, e)][k].append(str(i))
        return a, b, links, ";".join(f"{','.join(x)}|{','.join(y)}" for x, y in groups)

    return run


def expected(texts, plain):
    made = [plain(x) for x in texts]
    count = collections.Counter(p for m in made if m for p in set(m[2]))
    most = collections.Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    rows = []
    for m in made:
        if m is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            rows.append((len(m[0]), len(m[1]), m[3].count(";") + 1, len(m[2]), sum(count[p] == most[p[0]] for p in m[2]), sum(count[p] for p in m[2]), hashlib.sha256(m[3].encode()).hexdigest()))
    return rows, count


def test_contract(spark, plain):
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    want, _ = expected([r.text for r in rows], plain)
    got = {r[0]: tuple(r[1:]) for r in Q.op11_alignment(spark, SF).collect()}
    assert got == {r.doc_id: w for r, w in zip(rows, want, strict=True)}


def test_odd_texts(spark, plain, monkeypatch):
    """Also with blocks of a few texts and a worker that keeps no chunks."""
    rng = random.Random(3)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 12))) for _ in range(600)] + [None, "", " ", "\n", "a ", "lorem ipsum " * 9000, "x" * 40_000] + ["the same"] * 40
    want, count = expected(texts, plain)
    docs = spark.createDataFrame([(None if i % 50 == 7 else i // 2, x, "own", "own") for i, x in enumerate(texts)], "doc_id long, text string, block string, pair string").repartition(3)
    got = alignment.aligned(docs.withColumn("n_a", F.lit(1)), with_groups=True).collect()
    assert sorted(map(repr, (tuple(r[1:8]) for r in got))) == sorted(map(repr, want))
    assert sorted(str(r.doc_id) for r in got) == sorted(str(None if i % 50 == 7 else i // 2) for i in range(len(texts)))
    assert all(hashlib.sha256(r.groups.encode()).hexdigest() == r.groups_sha256 for r in got if r.groups)
    pairs = alignment.pair_counts(docs).collect()
    assert {(r.a_id, r.b_id): r.n_docs for r in pairs} == dict(count)
    chunks = alignment.Chunks(alignment.default_tokenizer(), alignment.default_pieces())
    for x in filter(None, texts[:300]):
        own = chunks.split(x)
        chunks.align()
        m = plain(x)
        assert (m is None) == (chunks.facts[own].sum(0)[0] < 0)
        if m:
            assert ";".join(chunks.groups[i] for i in own) == m[3]
        chunks.forget()


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.digest(none).count() == 0 and alignment.pair_counts(none).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r) for r in alignment.digest(blank).orderBy("doc_id").collect()] == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
