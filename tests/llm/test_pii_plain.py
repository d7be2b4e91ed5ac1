"""Added spans against a plain version of generators, features, trees, threshold and overlap."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_contract import base_spans

from lexigauge.llm import pii

SF = "/root/testdata/sf0.001"
I = re.IGNORECASE | re.ASCII  # noqa: E741  Java's


def compiled(p):
    return re.compile(p.replace("(?i)", ""), I if "(?i)" in p else re.ASCII)


def luhn(d):
    return sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_features(kind, m, left, right):
    d, runs = re.sub("[^0-9]", "", m), re.findall("[0-9]+", m)
    count = lambda p: len(re.findall(p, m))
    word = compiled(pii.WORDS[kind])
    return [
        *(len(m), len(d), count("[A-Za-z]"), len(runs), max(map(len, runs), default=0), count(" "), count(r"\."), count("-"), count(r"[()\[\]{}<>]"), count("/"), count(":")),
        13 <= len(d) <= 19 and luhn(d),
        bool(word.search(left) or compiled("^.{0,4}" + pii.WORDS[kind]).search(right)),
        bool(compiled(pii.AGAINST).search(left)),
        bool(re.match("[A-Za-z0-9]", right)),
        bool(re.search(r"(?:\.|dot\W{0,2})\x20?(?:com|org|net|edu|gov|io|de|fr|es|info|co|uk|eu|ru|cn|jp)$", m, I)),
        bool(re.search(r"[(\[{<]\x20?at|@", m, I)),
        int(d[0]) if d else -1,
    ]


def plain(text, models):
    """kind -> added spans."""
    base = base_spans(text)
    taken = [x for s in base for x in s]
    out = {}
    for kind in pii.KINDS:
        found = set()
        for k, p in enumerate(pii.WIDE[kind]):
            if k and not compiled(pii.SECOND[kind]).search(text):
                continue
            ms = list(compiled(p).finditer(text))
            for i, m in enumerate(ms):
                a, b = m.span()
                left = text[max(a - pii.AROUND, ms[i - 1].end() if i else 0) : a]
                right = text[b : min(b + pii.AROUND, ms[i + 1].start() if i + 1 < len(ms) else len(text))]
                if any(s < b and e > a for s, e in taken):
                    continue
                if models[kind].raw(np.array([plain_features(kind, m.group(), left, right)], float))[0] >= models[kind].threshold:
                    found.add((a, b))
        beats = lambda d, c: d[0] < c[1] and d[1] > c[0] and (d[1] - d[0], -d[0]) > (c[1] - c[0], -c[0])
        out[kind] = sorted(c for c in found if not any(beats(d, c) for d in found))
        taken += out[kind]
    return base, out


BITS = ["call ", "tel: ", "(212) 555-1234", "212.555.1234", "+49 30 1234567", "a.b (at) c (dot) com", "x at y dot org", "me@x.com", "card 4111.1111.1111.1111", "4111 1111 1111 1111", "10[.]0[.]3[.]7", "10.0.3.7", "fe80::1:2:3:4", "isbn 978-1234-567", ", ", " ", "\n", "é ", "order ", "4556/1234/1234/1234", "0049 123 4567890", "visa ", "12:30:15:01", "1 2 3 ", "[at]", "5555_4444_3333_2222"]


def test_added_spans(spark):
    models = pii.models(spark)
    rng = random.Random(8)
    texts = ["".join(rng.choices(BITS, k=rng.randint(1, 14))) for _ in range(400)] + [None, ""]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    # more spans than a block holds
    texts.append(" ".join(f"call (212) 555-{1000 + i} or 10[.]0[.]3[.]{i} or a{i} at b{i} dot com" for i in range(200)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    added = 0
    for r in pii.digest(df).collect():
        base, more = plain(texts[r.doc_id] or "", models)
        want = [f"{k}:{a}:{b}" for k, own in zip(pii.KINDS, base, strict=True) for a, b in sorted([*own, *more[k]])]
        assert r.spans == ",".join(want), texts[r.doc_id]
        added += sum(map(len, more.values()))
    assert added > 300


def test_ranges(spark):
    """Blocks of spans cover them in order."""
    spans = [(i * 3, i * 3 + 1 + i % 7, "x") for i in range(300)]
    df = spark.createDataFrame([(spans,), ([],), (spans[:1],)], f"a {pii.SPANS}")
    got = [r[0] for r in df.select(pii.ranges("a")).collect()]
    for own, blocks in zip((spans, [], spans[:1]), got, strict=True):
        parts = [own[i : i + pii.BLOCK] for i in range(0, len(own), pii.BLOCK)]
        assert [tuple(b) for b in blocks] == [(i, min(s for s, _, _ in p), max(e for _, e, _ in p)) for i, p in enumerate(parts)]


def test_trees_as_text(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (200, 3)).astype(float)
    model = pii.boosted(x, (x[:, 0] + x[:, 1] > 4).astype(float), np.arange(200) % 3 == 2)
    df = spark.createDataFrame([(r,) for r in x.tolist()], "x array<double>")
    assert [r[0] for r in df.select(F.expr(model.sql("x"))).collect()] == pytest.approx(model.raw(x).tolist())
