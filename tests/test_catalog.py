"""Queries against their SQL in DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tessera.operators import catalog

DIR = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DIR.exists(), reason="no test tables")
@pytest.mark.parametrize("name", catalog.oracle_sql())
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in DIR.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = catalog.queries()[name](spark, str(DIR))
    assert sorted(df.columns) == sorted(columns)
    got, want = (sorted((tuple(r) for r in rows), key=repr) for rows in (df.select(*columns).collect(), want.fetchall()))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) if isinstance(x, float) else x == y for x, y in zip(a, b)), (a, b)
