"""The contract's queries against SQL, brute force, exact round trips or held-out accuracy, on the smallest tables."""

import collections
import hashlib
import math
import re
import zlib
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexigauge.llm import quality
from lexigauge.llm import queries as Q
from lexigauge.llm.sampling import held_out

SF = "/root/testdata/sf0.001"
LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.fixture(scope="module")
def texts():
    return dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, con, name):
    df = Q.queries()[name](spark, SF)
    got = df.collect()
    res = con.execute(Q.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda rows, c: sorted(repr([r[c.index(x)] for x in sorted(c)]) for r in rows)
    assert key(got, df.columns) == key(res.fetchall(), cols)


@pytest.fixture(scope="module")
def ids(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in texts.items()}


def crc(x):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))


def test_token_files(spark, ids):
    got = {r.doc_id: r for r in Q.op9_token_files(spark, SF).collect()}
    at = 0
    assert len(got) == len(ids)
    for i in sorted(ids):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids[i]), crc(ids[i]))
        at += len(ids[i])


def test_packing(spark, ids):
    rows = Q.op4_packing(spark, SF).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, x in ids.items():
        ps = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in ps] == list(range(len(ps)))
        assert sum(r.length for r in ps) == len(x) and len(ps) == -(-len(x) // 1024)
        at = 0
        for k, r in enumerate(ps):
            assert r.start == at and r.ids_crc32 == crc(x[at : at + r.length]) and (k == 0 or r.length == 1024)
            at += r.length
    for ps in by_seq.values():
        at = 0
        for r in sorted(ps, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(map(len, ids.values()))
    assert len(by_seq) <= 1.02 * -(-total // 1024) + 1


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(x):
    d = lambda m: re.sub("[^0-9]", "", m.group())
    return [
        [m.span() for m in EMAIL.finditer(x)],
        [m.span() for m in IP.finditer(x) if all(int(p) <= 255 for p in m.group().split("."))],
        [m.span() for m in CARD.finditer(x) if 13 <= len(d(m)) <= 19 and luhn(d(m))],
        [m.span() for m in PHONE.finditer(x) if 9 <= len(d(m)) <= 15],
    ]


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for k, s in zip(("email", "ip", "card", "phone"), spans, strict=True) for a, b in s)


def test_personal_data(spark, texts):
    rows = Q.op8_personal_data(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        s = base_spans(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == list(map(len, s))
        assert r.base_sha256 == hashlib.sha256(listed(s).encode()).hexdigest()
        assert set(filter(None, listed(s).split(","))) <= set(r.spans.split(","))


def test_language_model(spark, texts):
    rows = Q.op7_language_model(spark, SF).collect()
    toks = {i: [*(x or "").encode().translate(LOW).split(), b""] for i, x in texts.items()}
    c = collections.Counter(w for i, t in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for r in rows:
        t = toks[r.doc_id]
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(t), n, sum(c[w] > 0 for w in t))
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language(spark, con):
    rows = Q.op5_language(spark, SF).collect()
    lang = dict(con.execute("select doc_id, lang from documents").fetchall())
    out = [r for r in rows if r.held_out]
    assert out and sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_toxicity(spark, con):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in Q.op10_toxicity(spark, sf).collect()}
    y = duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall()
    out = [(rows[i].predicted, t) for i, t in y if rows[i].held_out]
    assert out and sum(a == b for a, b in out) >= 0.93 * len(out)
    assert all(r.predicted == int(r.score >= 0.5) for r in rows.values())


def test_quality(spark):
    """Learned from three of four labelled documents, judged on the fourth."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    test = held_out("doc_id", 4, 1)
    rows = {r.doc_id: r.kept for r in quality.graded(docs, labels.where(~test)).collect()}
    y = [(r.doc_id, r.quality) for r in labels.where(test & labels.quality.isNotNull()).collect()]
    assert len(y) > 50 and sum(rows[i] == (q == 1) for i, q in y) >= 0.95 * len(y)
    assert Q.op1_quality(spark, sf).count() == len(rows)
