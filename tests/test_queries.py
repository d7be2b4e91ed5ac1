"""Every registered query of the core beside its SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from lexigauge.plans import morphs, probes  # noqa: F401  they add queries
from lexigauge.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def shown(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([f"{r[i]:.6g}" if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in Q.ORACLES:
        assert got
        return
    res = con.execute(Q.ORACLES[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert shown(got, df.columns) == shown(res.fetchall(), cols)


def test_registry():
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
