"""Every registered query against its SQL, on the smallest driver tables."""

from pathlib import Path

import pytest

from quillmatch.plans.oracle import ORACLE
from quillmatch.plans.queries import QUERIES

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in TABLES.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    rows = QUERIES[name](spark, str(TABLES)).collect()
    if name not in ORACLE:
        assert rows
        return
    rel = duck.sql(ORACLE[name])
    columns = sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in rows) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_entry():
    import __spark_entry__ as e

    assert set(ORACLE) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
