"""Every registered query of the core against its SQL on the smallest tables."""

import duckdb
import pytest

from larder.plans import oracles, queries
from tests.conftest import DATA

TABLES = "part lineitem events customer documents".split()
SQL = oracles.oracle_sql()


def text(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = db.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(text(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall())
