"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _own():
    from cinderlog import queries

    return queries


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


def _key(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(_own().SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = _own().QUERIES[name](spark, SF)
    found = duck.execute(_own().SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(_key(r[names.index(c)]) for c in df.columns) for r in found.fetchall())
    assert sorted(tuple(_key(v) for v in r) for r in df.collect()) == want


def test_queries_without_sql_run(spark):
    for name in sorted(set(_own().QUERIES) - set(_own().SQL)):
        assert _own().QUERIES[name](spark, SF).count() > 0, name
