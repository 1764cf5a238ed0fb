"""Every query of the engine against its SQL."""

from collections import Counter

import duckdb
import pytest

from quantloom.queries import ORACLES, QUERIES

AT = "/root/testdata/sf0.001"


def norm(v):
    return str(v)[:19] if hasattr(v, "isoformat") else repr(v + 0.0) if isinstance(v, float) else repr(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in ("events", "orders", "part", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{AT}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, AT)
    if name not in ORACLES:
        assert df.count() > 0
        return
    want, columns = con.sql(ORACLES[name]), sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert Counter(tuple(norm(r[c]) for c in columns) for r in df.collect()) == Counter(tuple(norm(r[i]) for i in at) for r in want.fetchall())
