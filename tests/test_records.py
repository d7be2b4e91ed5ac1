"""Records of JSON files by byte range, and capped scans of Parquet files."""

import json
import random

import pytest

from lexigauge.sources import corpus as C
from lexigauge.sources.records import json_records


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def made(n, rng):
    bits = ['"', "\\", "{", "}", "[", "]", "a", "é", "\n", ", ", '{"text": "x"}', "\\\\", " ", "东"]
    return [{"tokenizer_name": "t", "language": "en", "tokens": [rng.randrange(99) for _ in range(rng.randrange(6))], "text": "".join(rng.choices(bits, k=rng.randrange(30))), "metadata": rng.choice([{}, {"a": "}", "b": "{["}])} for _ in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("ascii_", [True, False])
def test_records(spark, tmp_path, small_blocks, indent, ascii_):
    """Blocks begin in strings, in nested objects and between records; a record goes over many blocks."""
    rng = random.Random(5)
    rows = made(60, rng) + [{"tokenizer_name": "t", "language": "en", "tokens": list(range(2000)), "text": "}{" * 1500, "metadata": {}}] + made(20, rng)
    (tmp_path / "flat.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=ascii_), encoding="utf-8")
    keyed = {'one "x"': rows[:30], "none": [], "tw}o": rows[30:75], "é": rows[75:]}
    (tmp_path / "keyed.json").write_text(json.dumps(keyed, indent=indent, ensure_ascii=ascii_), encoding="utf-8")
    got = json_records(spark, str(tmp_path / "flat.json")).orderBy("block", "i").collect()
    assert [json.loads(r.record) for r in got] == rows and {r.key for r in got} == {None}
    assert len({r.block for r in got}) > 3 and len({(r.file, r.block, r.i) for r in got}) == len(rows)
    got = json_records(spark, str(tmp_path / "keyed.json")).orderBy("block", "i").collect()
    assert [(r.key, json.loads(r.record)) for r in got] == [(k, r) for k, own in keyed.items() for r in own]
    x = C.read_tokenized(spark, str(tmp_path / "keyed.json")).collect()
    assert len(x) == len(rows) == len({r.doc_id for r in x}) and {r.tokenizer for r in x} == set(keyed) - {"none"}
    assert sorted((r.text, tuple(r.tokens)) for r in x) == sorted((r["text"], tuple(map(str, r["tokens"]))) for r in rows)


def test_forms(spark, tmp_path):
    for name, text, n in (("empty", "[]", 0), ("blank", "  [ ]\n", 0), ("one", '{"t": [{"text": "a"}]}', 1), ("nulls", '[null, {"text": null}, {}]', 2)):
        (tmp_path / f"{name}.json").write_text(text)
        assert json_records(spark, str(tmp_path / f"{name}.json")).count() == n
    (tmp_path / "no.json").write_text('"text"')
    with pytest.raises(ValueError, match="neither"):
        json_records(spark, str(tmp_path / "no.json"))


def test_capped_files(spark, tmp_path):
    """Only the first files are in the plan; blank texts make it read on."""
    for i in range(8):
        rows = [("" if i in (1, 2) else f"text {i} {j}",) for j in range(5)]
        spark.createDataFrame(rows, "text string").coalesce(1).write.parquet(str(tmp_path / f"all/{i}"))
        (next((tmp_path / f"all/{i}").glob("part-*.parquet"))).rename(tmp_path / f"{i}.parquet")
    path = str(tmp_path)
    for most, files in ((3, 1), (5, 1), (6, 4), (1000, 8)):
        x = C.read_language(spark, path, "en", most)
        assert x.count() == min(most, 30)
        opened = {f.rpartition("/")[2] for f in x.select("source").distinct().toPandas()["source"]}
        plan = x._jdf.queryExecution().optimizedPlan().toString()
        assert len(opened) <= files and plan
        assert len(C.first_files(spark, sorted(C.listed(spark, path)), most)) == files
    got = [r.text for r in C.read_language(spark, path, "en", 7).orderBy("place").collect()]
    assert got[:5] == [f"text 0 {j}" for j in range(5)] and len(got) == 7
