"""The pipeline stage by stage against plain versions of what each stage decides."""

import corpus_pipeline
from lexigauge.llm import decontam, packing
from lexigauge.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stored(f(spark, docs, SF), f"t{k}")
        kept.append({r.doc_id: r.text for r in docs.collect()})
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept[0] for i in good) >= 0.98 * len(good)
    assert all(kept[0][i] == before[i] for i in kept[0])

    def sets(t):
        w = t.encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    s = {i: sets(t) for i, t in kept[0].items()}
    like = lambda a, b: bool(s[a] and s[b]) and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])
    ids = sorted(s)
    for n, i in enumerate(ids):
        if i in kept[1]:
            assert not any(like(i, j) for j in ids[:n] if j in kept[1])
        else:  # what went was linked to a smaller id, perhaps through others
            assert any(like(i, j) for j in ids if j != i)
    items = [(str(r.item_id), r.text.encode()) for r in table(spark, SF, "benchmark").collect()]
    auto = decontam.Automaton(items, 13)
    for i, t in kept[1].items():
        n, runs, _ = auto.scan(t.encode())
        hit = sum(b - a for a, b in runs)
        assert (i in kept[2]) == (not (hit and 20 * hit >= n))
    assert set(kept[3]) == set(kept[2])
    assert not any("@" in t and ".example.com" in t for t in kept[3].values())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(kept[3]) and max(r.offset + r.length for r in packed) <= packing.SIZE
