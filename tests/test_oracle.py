"""Every query of the core against its SQL on DuckDB."""

import math
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not there")

from assaykit.operators.oracle import ORACLE  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return v if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, con, name):
    from assaykit.operators.catalogue import QUERIES

    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    ran = con.execute(ORACLE[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in ran.fetchall()), key=str)
    assert got == want


def test_other_queries_run(spark):
    from assaykit.operators.catalogue import QUERIES

    for name in sorted(set(QUERIES) - set(ORACLE)):
        assert QUERIES[name](spark, str(DATA)).count() > 0, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
