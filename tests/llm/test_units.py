"""The operators' parts against plain versions."""

import math
import random
import re

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexigauge.llm import boosting, decontam, dedup, encode, graph, hmm, langid, packing, pii, quality, token_files, topk, toxicity
from lexigauge.llm.common import OWN


def test_encoder_is_the_library():
    e = encode.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    parts = ["a", "é", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "!", "\x1c", "<|endoftext|>", "日", "😀", "Word", "İ", ".", "\r\n", "\x85", "´"]
    for _ in range(2000):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert e.encode(x) == e.whole(x), repr(x)


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(np.minimum(np.exp(rng.normal(5, 1, 3000)).astype(int) + 1, 1024), minlength=1025)
    chosen = packing.plan(counts, 1024)
    used = np.zeros(1025, int)
    for p, n in chosen:
        assert sum(p) <= 1024
        for x in p:
            used[x] += n
    assert (used == counts).all()
    assert sum(n for _, n in chosen) <= 1.01 * -(-int((counts * np.arange(1025)).sum()) // 1024) + 1
    for k, rows in packing.places(chosen).items():
        assert rows[0, 0] == 0 and rows[-1, 0] + rows[-1, 3] == counts[k]


def test_least_squares():
    rows, cols = np.array([0, 1, 0, 2]), np.array([0, 0, 1, 1])
    x = packing.nnls(rows, cols, np.ones(4), np.array([3.0, 1.0, 2.0]), 2, 2000)
    assert x == pytest.approx([1, 2], abs=1e-3)


def test_empty_plan():
    assert packing.plan(np.zeros(1025, int), 1024) == []


def test_sketch_agrees_with_similarity():
    rng = np.random.default_rng(3)
    for n, share in ((5, 0.6), (60, 0.8), (2000, 0.85)):
        errs = []
        for _ in range(20):
            both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
            a = np.unique(np.r_[both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)])
            b = np.unique(np.r_[both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)])
            s = dedup.sketches([a, b])
            assert (s != np.uint64(2**64 - 1)).all()
            errs.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errs)) < 0.06


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in graph.components(links).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert graph.components(links.where("a > 99")).count() == 0
    rng = random.Random(6)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i + 1000, i + 1001) for i in range(100)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()} == {x: find(x) for x in linked}


def families(seed):
    """Documents whose family members drift, so that links form chains and some pairs of a bucket are not linked; their components."""
    rng = random.Random(seed)
    docs, n = [], 0
    for f in range(8):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(60)]
        for _ in range(14):
            docs.append((n, " ".join(words)))
            n += 1
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(60)] = f"x{f}{rng.randint(0, 5000)}"
    base = [f"b{i}" for i in range(80)]
    for _ in range(60):  # one large family around a base
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(80)] = f"y{rng.randint(0, 10**6)}"
        docs.append((n, " ".join(w)))
        n += 1
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in docs for w in [t.split()]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return docs, {i: find(i) for i in sets}


@pytest.mark.parametrize("block", [256, 8, 2])
def test_near_duplicates_brute_force(spark, monkeypatch, block):
    """In whole clusters, and in stars and blocks."""
    monkeypatch.setattr(dedup, "BLOCK", block)
    docs, want = families(block)
    got = dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=3, num=85).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_links_grow_with_the_members(spark, monkeypatch):
    """Near copies of one text: what is handed on is in proportion to them."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    whole, sizes = dedup.components, []
    monkeypatch.setattr(dedup, "components", lambda x: sizes.append(x.distinct().count()) or whole(x))
    for n in (600, 1800):
        docs = []
        for i in range(n):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(120)] = f"y{rng.randint(0, 10**6)}"
            docs.append((i, " ".join(w)))
        got = dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=3, num=85).collect()
        assert sum(r.component_id == 0 for r in got) >= 0.99 * n
        assert sizes[-1] < 4 * n


def test_near_duplicates_hot_ids(spark):
    """Many different texts under one id and under null: each class finds its text by digest."""
    t = lambda f, i: " ".join(f"{f}{k}" for k in range(40)) + f" v{i}"
    rows = [(0, t(f"f{i // 2}x", i)) for i in range(40)] + [(None, t(f"g{i // 2}x", i)) for i in range(40)] + [(5, t("f3x", 99)), (6, t("g4x", 99))]
    got = dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=3, num=80).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id == 0} == {0}
    assert sorted(r.component_id is None for r in got if r.doc_id is None) == [False] * 2 + [True] * 38
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (5, 6)} == {5: 0, 6: 6}


def test_common_shingles(monkeypatch):
    monkeypatch.setattr(dedup, "WIDE", 5)
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, n).astype(np.uint64)) for n in (1, 10, 40, 30, 7)]
    got = dedup.common(sets[:2], sets[2:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:2]]).all()
    apart = ~np.eye(len(sets), dtype=bool)
    assert (dedup.common(sets) == [[len(np.intersect1d(a, b)) for b in sets] for a in sets])[apart].all()


def brute_hits(text, items):
    w = decontam.words(text.encode())
    hit, found = set(), set()
    for i, t in items:
        for k in decontam.windows_of([(i, t.encode())], 13):
            for s in range(len(w) - len(k) + 1):
                if tuple(w[s : s + len(k)]) == k:
                    hit.update(range(s, s + len(k)))
                    found.add(i)
    return len(w), len(hit), sorted(found)


def test_decontamination_in_several_passes(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 400)}"
    items = [(str(i), " ".join(word() for _ in range(rng.choice([1, 5, 13, 20, 40])))) for i in range(30)]
    docs = []
    for i in range(60):
        t = [word() for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(items)[1].split()
            a = rng.randint(0, max(0, len(w) - 15))
            t[len(t) // 2 : len(t) // 2] = w[a : a + 25]
        docs.append((i, "  ".join(t).title()))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for most in (10**6, 1500):
        got = {r.doc_id: r for r in decontam.contamination(d, b, max_bytes=most).collect()}
        for i, t in docs:
            n, hit, found = brute_hits(t, items)
            r = got[i].asDict()
            assert (r[OWN + "n_words"], r[OWN + "n_hit"], r[OWN + "items"]) == (n, hit, found)
            assert r[OWN + "contaminated"] == (hit > 0 and 20 * hit >= n)
            s = r[OWN + "spans"]
            assert sum(len(decontam.words(t[x:y].encode())) for x, y in zip(s[::2], s[1::2], strict=True)) == hit


def test_trees_as_sql(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    m = boosting.boosted(x, y, np.arange(300) % 3 == 2, trees=5)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = [r[0] for r in df.select(m.column([F.col(c) for c in "abc"])).collect()]
    assert got == pytest.approx(list(m.raw(x)))
    assert ((m.raw(x) > 0) == (y > 0)).mean() > 0.9


def test_added_spans(spark):
    good = ["mail me at anna.berg (at) firm (dot) com please", "call (212) 555-0187 today", "tel. 030 1234 5678", "visa 4111.1111.1111.1111 ok", "host 2001:db8:85a3:0:0:8a2e:370:7334 up"]
    clean = ["we met at noon and sat at home. fine", "from 1998-2004 in 12 towns", "version 3.11.2 of the tool", "pages 123-145", "a ratio of 3:4:5:6", "order 1234-5678-9012"]
    df = spark.createDataFrame(list(enumerate(good + clean)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.digest(df).collect()}
    assert all(got[i] for i in range(len(good))), got
    assert not any(got[len(good) + i] for i in range(len(clean))), got


def test_prefix_sums(spark):
    n = 1000
    df = spark.createDataFrame([([i % 7 for i in range(n)],), ([],), ([3],)], "x array<bigint>")
    got = [list(r[0]) for r in df.select(F.when(F.size("x") > 0, pii.before(F.col("x"))).otherwise(F.array().cast("array<bigint>"))).collect()]
    assert got == [[sum(i % 7 for i in range(k)) for k in range(n)], [], [0]]


def test_hmm_likelihood_is_exact_and_rises():
    rng = np.random.default_rng(2)
    p = hmm.initial(np.full(6, 1 / 6), 3)
    texts = [rng.integers(0, 6, n) for n in (1, 4, 300, 7)]
    got = hmm.likelihood(p, texts)
    for x, ll in zip(texts, got, strict=True):
        a, total = p.start * p.emit[x[0]], 0.0
        for o in x[1:]:
            total += np.log(a.sum())
            a = (a / a.sum()) @ p.step * p.emit[o]
        assert ll == pytest.approx(total + np.log(a.sum()))
    seq = [np.r_[[i % 3 for i in range(200)], 5] for _ in range(5)]
    last = -np.inf
    for _ in range(5):
        *e, ll = hmm.expected(p, *hmm.runs(seq))
        assert ll > last - 1e-6
        last = ll
        p = hmm.maximised(p, *e, np.full(6, 1e-4))
    # counts of all runs add up to the tokens
    assert e[2].sum() == pytest.approx(sum(map(len, seq)))


def test_hmm_counts_whole_texts():
    rng = np.random.default_rng(3)
    p = hmm.initial(np.full(6, 1 / 6), 3)
    texts = [rng.integers(0, 6, n) for n in (1, 700, 7, 513, 256)]
    start, step, emit, ll = hmm.expected(p, *hmm.runs(texts))
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))]
    for x in texts:
        f, b = [p.start * p.emit[x[0]]], [np.ones(3)]
        f[0] = f[0] / f[0].sum()
        for o in x[1:]:
            f.append(f[-1] @ p.step * p.emit[o])
            f[-1] /= f[-1].sum()
        for o in x[:0:-1]:
            b.insert(0, p.step @ (p.emit[o] * b[0]))
            b[0] /= b[0].sum()
        g = [u * v / (u * v).sum() for u, v in zip(f, b, strict=True)]
        want[0] += g[0]
        for o, q in zip(x, g, strict=True):
            want[2][o] += q
        for i in range(len(x) - 1):
            xi = f[i][:, None] * p.step * (p.emit[x[i + 1]] * b[i + 1])
            want[1] += xi / xi.sum()
    for got, w in zip((start, step, emit), want, strict=True):
        assert got == pytest.approx(w, rel=1e-8)
    assert step.sum() == pytest.approx(sum(len(x) - 1 for x in texts))
    assert ll == pytest.approx(hmm.likelihood(p, texts).sum())


def test_hmm_classes_grow(spark):
    counts = spark.createDataFrame([("", 5), *((f"w{i}", 1000 - 3 * i) for i in range(330))], "token string, c long")
    assert hmm.Model(spark, counts, 10, 1000, 2).classes == 301
    few = hmm.Model(spark, counts, 10, 50, 2)
    assert 40 <= few.classes == len(few.head) <= 50 and few.head[0] == b"w0" and few.c.min() >= 1000 - 3 * 50
    assert hmm.Model(spark, counts, 320, 1000, 2).classes == 320


def test_ordinal_with_four_grades():
    rng = np.random.default_rng(0)
    n = 600
    z = rng.normal(size=n)
    y = np.digitize(z, [-1, 0, 1])
    row, col, val = np.arange(n), np.zeros(n, int), z
    m = quality.descend(row, col, val, y, [1.0, 2.0, 3.0, 5.0], 1, 300, 0.0)
    assert (np.diff(m.thresholds) > 0).all()
    s = m.weights[0] * z
    t = m.tails(s)
    assert (np.diff(t, axis=1) <= 0).all()
    e = m.expected(s)
    assert np.corrcoef(e, y)[0, 1] > 0.9 and 1 <= e.min() and e.max() <= 5


def test_top_k_over_many_annuli(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "CHUNK", 7)
    monkeypatch.setattr(topk, "STRIDE", 8)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 6)).astype(np.float32)
    v[100:250] = v[100]  # one very common vector
    rows = [(i, [float(a) for a in x]) for i, x in enumerate(v)] + [(900, None), (901, [None, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, []), (905, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    q = {i: np.r_[np.floor(64 * np.array(x, np.float64)), np.zeros(6 - len(x))].astype(int) for i, x in rows if x is not None and None not in x and np.isfinite(x).all()}
    assert set(got) == {i for i in q if i % 20 == 0}
    for i, g in got.items():
        want = sorted(((-int(q[i] @ q[j]), j) for j in q if j != i))[:20]
        assert [(v, -s) for s, v in want] == [(v, s) for _, v, s in sorted(g)]


def test_hmm_start_is_fitted_to_all_texts(spark):
    """More texts than any sample: what training starts from follows from the adjacent words of all of them, counted plainly."""
    rng = np.random.default_rng(3)
    rows = [(i, None if i % 50 == 0 else " ".join(f"w{int(x)}" for x in rng.integers(0, 9, int(rng.integers(0, 12))))) for i in range(4000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    counts = hmm.counted(d.select("text")).cache()
    m = hmm.train(d, counts, states=3, classes=6, head=7, warm=30, passes=0)
    k, index = m.classes, {w.decode(): i for i, w in enumerate(m.head)}
    pairs = np.zeros((k + 2, k + 2))
    for _, text in rows:
        x = [min(index.get(w, k), k) for w in (text or "").split()] + [k + 1]
        for a, b in zip(x, x[1:]):  # noqa: B905
            pairs[a, b] += 1
    assert (hmm.adjacent(d.select("text"), m) == pairs).all()
    want = hmm.started(pairs, m.base, 3, 30)
    for a, b in ((m.params.start, want.start), (m.params.step, want.step), (m.params.emit, want.emit)):
        assert np.allclose(a, b, rtol=1e-9)
    assert np.allclose(m.params.emit.sum(0), 1) and np.allclose(m.params.step.sum(1), 1)
    q, e = m.params.start, m.params.emit  # pairs fit better than at the start without them
    fit = lambda p: (pairs * np.log(p.emit @ (p.step * p.start[:, None]) @ p.emit.T)).sum()
    assert fit(m.params) > fit(hmm.initial(m.base, 3)) and len(q) == 3 and e.shape == (k + 2, 3)


def test_hmm_scores_brute_force(spark):
    """scored() against the plain recursion, with a head so small that most words are joined."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocab, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 40)))) for i in range(80)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    learn = d.where("doc_id < 60")
    counts = hmm.counted(learn.select("text"))
    m = hmm.train(learn, counts, states=3, classes=4, head=12, warm=20, passes=1)
    c = {r.token.encode(): r.c for r in counts.collect()}
    assert 4 <= len(m.head) <= 12 and m.classes == 4
    top, p = {w: i for i, w in enumerate(m.head[:4])}, m.params
    assert p.emit.sum(0) == pytest.approx(1) and p.step.sum(1) == pytest.approx(1)
    for r in hmm.scored(d, m, counts).collect():
        w = dict(docs)[r.doc_id].encode().split()
        total, a = 0.0, p.start
        for k, x in enumerate([*w, None]):
            obs = 5 if x is None else top.get(x, 4)
            a = (a @ p.step if k else a) * p.emit[obs]
            total += np.log10(a.sum())
            a = a / a.sum()
            if obs == 4:  # within the others' class, by add-one counts
                total += np.log10((c.get(x, 0) + 1) / m.rest)
        assert r.score == pytest.approx(total)


def test_token_file_footers(spark, tmp_path):
    """Encodings, row groups and page indexes as asked for, and a read of one range and column that leaves the rest."""
    d = spark.range(4000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 60), x -> concat('w', (id * 7 + x * x) % 997))) as text")
    for encoding in ("delta", "dictionary"):
        path = tmp_path / encoding
        token_files.write_tokens(d, str(path), encoding=encoding, partitions=1, row_group_mb=1, page_kb=64)
        files = sorted(path.glob("*.parquet"))
        meta = pq.ParquetFile(files[0]).metadata
        assert sum(pq.ParquetFile(f).metadata.num_rows for f in files) == 4000
        cols = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
        ids = next(i for p, i in cols.items() if p.startswith("ids"))
        for g in range(meta.num_row_groups):
            x = meta.row_group(g).column(ids)
            assert ("DELTA_BINARY_PACKED" in x.encodings) == (encoding == "delta")
            assert any("DICTIONARY" in e for e in x.encodings) == (encoding == "dictionary")
            assert x.compression == "ZSTD" and meta.row_group(g).column(cols["doc_id"]).has_offset_index
        if encoding == "delta":
            assert meta.num_row_groups > 1
        got = token_files.read_tokens(spark, str(path)).where("doc_id between 100 and 103").select("doc_id", "n_tokens")
        assert sorted((r.doc_id, r.n_tokens > 60) for r in got.collect()) == [(i, True) for i in range(100, 104)]
        plan = got._jdf.queryExecution().toString()
        scan = plan[plan.index("== Physical") :]
        assert "GreaterThanOrEqual(doc_id,100)" in scan and "ids" not in scan.split("ReadSchema:")[1].split("\n")[0]


def test_token_files_are_ordered_by_number(spark, tmp_path):
    d = spark.createDataFrame([(i, "a b") for i in range(4)], "doc_id long, text string")
    token_files.write_tokens(d, str(tmp_path / "x"), partitions=4)
    for k, f in enumerate(sorted((tmp_path / "x").glob("part-*.parquet"))):
        f.rename(f.with_name(f"part-{99998 + k}-0.c000.zstd.parquet"))
    got = {r.doc_id: r.start for r in token_files.catalog(spark, str(tmp_path / "x")).collect()}
    n = token_files.catalog(spark, str(tmp_path / "x")).first().n_tokens
    assert got == {i: i * n for i in range(4)}


def test_language_scores_brute_force(spark):
    """predicted() against word-first backoff written plainly."""
    texts = [(0, "der hund und die katze", "de"), (1, "the dog and the cat", "en"), (2, "le chien et le chat", "fr"), (3, "the cat sat", "en")]
    m = langid.fit(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    langs = ["de", "en", "fr"]
    seen = {n: {x: [0] * 3 for x in ()} for n in range(6)}
    for _, t, lang in texts:
        for w in t.split():
            for n in range(6):
                for x in [w] if not n else [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]:
                    seen[n].setdefault(x, [0] * 3)[langs.index(lang)] += 1

    def log(n, x):
        return [math.log((seen[n][x][k] + 0.5) / (sum(v[k] for v in seen[n].values()) + 0.5 * (len(seen[n]) + 1))) for k in range(3)]

    asked = ["the dogs", "katzen hunde", "chats noirs", "zzz the", "a"]
    got = langid.predicted(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), m).orderBy("doc_id").collect()
    for t, r in zip(asked, got, strict=True):
        total = [0.0] * 3
        for w in t.split():
            if w in seen[0]:
                found = [log(0, w)]
            else:
                n = next((n for n in range(5, 0, -1) if any(g in seen[n] for g in langid.grams(w.encode(), n))), 0)
                found = [log(n, g) for g in langid.grams(w.encode(), n) if g in seen[n]] if n else [[0.0] * 3]
            total = [a + sum(x[k] for x in found) / len(found) for k, a in enumerate(total)]
        best = max(range(3), key=lambda k: total[k])
        assert r["__lx_lang_pred"] == langs[best]
        assert r["__lx_score"] == pytest.approx(1 / sum(math.exp(x - total[best]) for x in total), rel=1e-4)


def test_noisy_or_brute_force(spark):
    rng = np.random.default_rng(3)
    weights, bias = rng.normal(0, 1, 1 << toxicity.BITS).astype(np.float32), -2.0
    texts = ["You are BAD. fine day! x", "", "one two three\nfour", "a a a. a"]
    rows = toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (weights, bias)).orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        p = []
        for s in re.split(r"[.!?\n]+", t.lower()):
            if s.split():
                p.append(1 / (1 + math.exp(-(sum(float(weights[toxicity.places(w.encode())].sum()) for w in set(s.split())) + bias))))
        p = p or [1 / (1 + math.exp(-bias))]
        assert r["__lx_score"] == pytest.approx(1 - math.prod(1 - x for x in p), rel=1e-5)
        assert r["__lx_worst"] == p.index(max(p))


def test_ordinal_scores_brute_force(spark):
    rng = np.random.default_rng(4)
    size = (2 << quality.BITS) + quality.EXTRA
    m = quality.Ordinal([1.0, 2.0, 4.0], np.array([-0.5, 0.7]), rng.normal(0, 1, size).astype(np.float32))
    texts = ["Some Words some words", "", None, "x x x x 12 34!"]
    rows = quality.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        w = (t or "").encode().split()
        z = sum(float(m.weights[k]) for x in w for k in quality.slots(x)) / max(1, len(w))
        z += sum(float(m.weights[(2 << quality.BITS) + k]) * v for k, v in quality.whole_text(len(w), len(set(w)), sum(a == b for a, b in zip(w, w[1:], strict=False)), len(t or "") - len(w) + 1 if w else 0))
        tails = [1 / (1 + math.exp(-(z - t))) for t in m.thresholds]
        assert (r["__lx_score"], r["__lx_tail"]) == pytest.approx((z, tails[0]))
        assert r["__lx_expected_grade"] == pytest.approx(1 + tails[0] + 2 * tails[1])


def test_top_k_bounds_skip(spark):
    """On clustered vectors, the triangle inequality leaves out most of them once a query's k-th score is known."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(16, 32)) * 3
    v = centres[rng.integers(0, 16, 2000)] + rng.normal(size=(2000, 32)) * 0.15
    df = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    index = topk.fit(topk.valid(df, "vec_id", "embedding"))
    w = np.floor(64 * v).astype(np.int64)
    asked = w[::20]
    scores = asked @ w.T
    scores[np.arange(len(asked)), np.arange(0, 2000, 20)] = -(10**15)
    tau = np.sort(scores, 1)[:, -20].astype(float)
    qq, d, _ = index.asked(asked)
    p, dist, _ = index.keyed(w)
    inside = index.best(qq[:, None], np.abs(d[:, p] - dist[None, :])) >= tau[:, None]
    assert (inside | (scores < tau[:, None])).all()  # nothing of the result is left out
    assert inside.mean() < 0.2


def test_added_spans_of_templates_kept_from_fitting(spark):
    """Precision and recall on templates that the trees have not seen."""
    for kind, m in pii.models(spark).items():
        x, y, held = pii.judged_examples(spark, kind)
        found = m.raw(x[held]) >= m.threshold
        assert found[y[held] > 0].mean() >= 0.95 and (y[held][found] > 0).mean() >= 0.95


def test_worker_keeps_one():
    """What an operator keeps in a worker goes when another needs its own."""
    from lexigauge.llm.common import cached_in_worker

    keep, made = {}, []

    def get(key):
        return cached_in_worker(key, lambda: made.append(key) or key.upper(), keep)

    assert [get("a:1"), get("a:1"), get("b:1"), get("a:1")] == ["A:1", "A:1", "B:1", "A:1"]
    assert made == ["a:1", "b:1", "a:1"] and set(keep) == {"a:1"}
