"""Every query of the core beside its SQL in DuckDB, at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from compare import rows
from weftline import queries as core


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sf, db, name):
    df = core.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in core.SQL:
        assert got or name == "recurrent_sample"  # no page of the smallest tables repeats a class
        return
    r = db.execute(core.SQL[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, r.fetchall())
