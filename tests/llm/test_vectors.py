"""Near-duplicate vectors and whitening against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigauge.llm import queries as Q
from lexigauge.llm import vector_dedup, whitening
from lexigauge.llm.common import table

SF = "/root/testdata/sf0.001"


def unit(x):
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plain_links(rows, cosine=0.93):
    """vec_id, label, vector -> sorted (vec_id, n_links, component_id, kept)."""
    ok = [v is not None and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, lab, v in rows]
    n, link = len(rows), {}
    for i in range(n):
        link[i] = [j for j in range(n) if j != i and ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]) and float(unit(np.array([rows[i][2]]))[0] @ unit(np.array([rows[j][2]]))[0]) >= cosine]
    comp = list(range(n))
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        comp[i] = min(ids) if ids else None
    return sorted(map(repr, ((rows[i][0], len(link[i]), comp[i], rows[i][0] is not None and rows[i][0] == comp[i]) for i in range(n))))


def grouped(rng, n, dim, spread, groups):
    base = rng.standard_normal((groups, dim))
    return base[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, dim))


@pytest.mark.parametrize("spread", [0.01, 0.1, 0.3])
def test_trees(spread):
    """Weights linked and what is connected, for two trees; the trees leave out most where groups are tight."""
    rng = np.random.default_rng(int(100 * spread))
    both = unit(grouped(rng, 560, 16, spread, 20))
    a, b = both[:300], both[300:]
    wa, wb = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
    (oa, ta), (ob, tb) = vector_dedup.grown(a), vector_dedup.grown(b)
    for t, pts in ((ta, a[oa]), (tb, b[ob])):
        for k in range(len(t["lo"])):  # covering radii hold, children cover their parent, its centre is a child's
            own = pts[t["lo"][k] : t["hi"][k]]
            assert np.sqrt(np.maximum(0, 2 - 2 * own @ pts[t["centre"][k]])).max() <= t["radius"][k] + 1e-12
            kids = range(t["first"][k], t["last"][k])
            if kids:
                assert sum(t["hi"][j] - t["lo"][j] for j in kids) == t["hi"][k] - t["lo"][k] and t["centre"][k] in t["centre"][list(kids)]
    trees = vector_dedup.Tree(a[oa], wa[oa], **ta), vector_dedup.Tree(b[ob], wb[ob], **tb)
    got_a, got_b, edges, spans = vector_dedup.near_pairs(*trees, 0.93)
    m = a[oa] @ b[ob].T >= 0.93
    assert (got_a == m @ wb[ob]).all() and (got_b == m.T @ wa[oa]).all()
    joined = [(x, y + len(a)) for x, y in edges.tolist()] + [(lo + side * len(a), x + side * len(a)) for side, lo, hi in spans.tolist() for x in range(lo, hi)]
    size = len(a) + len(b)
    i, j = np.nonzero(m)
    assert (vector_dedup.forest(size, np.array(joined).reshape(-1, 2)) == vector_dedup.forest(size, np.stack([i, j + len(a)], 1))).all()
    if spread == 0.01:
        assert len(edges) < m.sum() / 20


ODD = [(1, 1, [1.0, 0.0]), (2, 1, [2.0, 0.001]), (2, 1, [2.0, 0.001]), (3, 2, [1.0, 0.0]), (4, None, [1.0, 0.0]), (None, 1, [1.0, 0.01]), (5, 1, None), (6, 1, []), (7, 1, [0.0, 0.0]), (8, 1, [1.0, None]), (9, 1, [math.nan, 1.0]), (10, 1, [math.inf, 1.0]), (11, 1, [1.0, 0.0, 0.0]), (12, 1, [-0.0, 1e-200]), (13, 1, [0.0, 1e200]), (None, 3, [1.0, 1.0]), (14, 1, [1.0, 0.0]), (14, 1, [0.0, 1.0])]


def test_near_duplicates(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([grouped(rng, 500, 8, 0.12, 30), grouped(rng, 100, 8, 0.001, 1)])
    rows = [(i // 2 if i % 97 == 0 else 100 + i, int(min(i % 4, 2)), [*map(float, v)]) for i, v in enumerate(x)] + [(3000 + i, 1, [1.0] * 8) for i in range(60)]
    schema = "vec_id long, label int, embedding array<double>, block string, n long"
    for data, kw in ((rows, {"block": 40, "sample": 100}), (rows, {}), (ODD, {})):
        df = spark.createDataFrame([(*r, "own", 1) for r in data], schema)
        got = vector_dedup.near_duplicates(df, **kw).collect()
        assert sorted(repr(tuple(r)) for r in got) == plain_links(data)
    assert vector_dedup.digest(df.where("1 = 0")).count() == 0


def test_compared_in_tiles():
    """Single precision only leaves out; pairs next to the threshold are told apart in double precision."""
    rng = np.random.default_rng(4)
    a = unit(rng.standard_normal((700, 24)))
    other = unit(rng.standard_normal((700, 24)))
    other = unit(other - a * (a * other).sum(1, keepdims=True))
    cos = 0.93 + rng.choice([-1, 1], 700) * 10.0 ** rng.integers(-12, -2, 700)
    b = a * cos[:, None] + other * np.sqrt(1 - cos**2)[:, None]
    trees = [vector_dedup.Tree(x, *[None] * 7) for x in (a, b)]
    at = np.arange(700)
    i, j = vector_dedup.compared(trees[0], at, trees[1], at, 0.93)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= 0.93)), strict=True))
    assert (np.isin(at, i[i == j]) == (cos > 0.93)).all()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_bundles_meet(spark, kind):
    """Pairs of bundles meet, not pairs of blocks: a vector is sent for each bundle, and results stay those of all pairs."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((300, 12)), grouped(rng, 100, 12, 0.15, 10)]).astype(np.float32)
    data = [(i, int(i % 2), [*map(float, v)]) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, f"vec_id long, label int, embedding array<{kind}>")
    _, made = vector_dedup.classes(df, "vec_id", "embedding", "label")
    built = vector_dedup.blocks(made, 8, 500).withColumn("block", F.xxhash64("grp", "cell", "part")).cache()
    rows = [(len(r[0]), len(r[1] or [])) for r in vector_dedup.meetings(built, 0.93, 40).select("blocks_a", "blocks_b").collect()]
    n = built.count()
    assert n >= 60 and len(rows) <= 2 * 5 * 6 / 2 and sum(a for a, b in rows if not b) == n
    own = vector_dedup.near_duplicates(df, block=8, sample=500).collect()
    assert sorted(repr(tuple(r)) for r in own) == plain_links(data)


def plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return x, n, s, c, e[::-1], u[:, ::-1]


def test_whitening_contract(spark):
    src = {r.vec_id: r.embedding for r in table(spark, SF, "embeddings").collect()}
    rows = Q.op13_whitening(spark, SF).collect()
    ids = sorted(src)
    x, n, s, c, e, u = plain_whitening([src[i] for i in ids])
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(by) == 8 * n
    for k in range(8):
        own = np.array([by[i, k + 1].whitened for i in ids])
        want = c @ u[:, k] / math.sqrt(e[k])
        assert np.abs(own * np.sign(own @ want) - want).max() < 1e-9
        assert by[ids[0], k + 1].explained == pytest.approx(e[k] / e.sum(), rel=1e-9)
    assert [by[i, 1].deviation for i in ids] == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    assert {r.n for r in rows} == {n} and max(r.identity_error for r in rows) < 1e-10


def test_range_finder_settles(spark):
    """A spectrum that falls fast needs no full pass; a flat one does; both give the plain components."""
    rng = np.random.default_rng(2)
    steep = rng.standard_normal((300, 40)) * np.concatenate([[400, 300, 200, 100], np.full(36, 1e-7)]) @ np.linalg.qr(rng.standard_normal((40, 40)))[0]
    for vectors, full in ((steep, None), (rng.standard_normal((300, 40)), True)):
        df = spark.createDataFrame([(i, [*map(float, v)]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        model = whitening.fit(df, components=4, passes=12 if full is None else 3)
        *_, c, e, u = plain_whitening(vectors)
        if full:
            assert model.full
        assert np.allclose(model.values, e[:4], rtol=1e-10)
        assert np.allclose(np.abs((model.vectors * u[:, :4]).sum(0)), 1, atol=1e-9)
        got = whitening.whitened(df, model).collect()
        w = np.array([r.whitened for r in got])
        assert np.abs(w.T @ w / 300 - np.eye(4)).max() < 1e-6 and whitening.identity_error(df, model) < 1e-6


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>, n long, component string"
    make = lambda vs: spark.createDataFrame([(i, v, 1, "own") for i, v in vs], schema)
    good = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [1.0, 3.0]), (3, [2.0, -1.0])]
    odd = [(4, None), (5, []), (6, [1.0]), (7, [1.0, None]), (8, [math.nan, 0.0]), (9, [math.inf, 0.0])]
    rows = whitening.digest(make(good + odd)).collect()
    assert sorted(str(r.vec_id) for r in rows) == sorted(["1", "1", "1", "1", "None", "None", "3", "3"])
    x, n, s, *_ = plain_whitening([v for _, v in good])
    assert {(r.vec_id, r.deviation) for r in rows} == {(i, sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True))) for (i, _), row in zip(good, x, strict=True)}
    for none in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], odd[:2]):
        assert whitening.digest(make(none)).count() == 0
    line = whitening.digest(make([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()
    assert {r.component for r in line} == {1}
    huge = whitening.digest(make([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])])).collect()
    assert all(math.isfinite(r.whitened) for r in huge) and {r.deviation for r in huge if r.vec_id < 3} == {None}
