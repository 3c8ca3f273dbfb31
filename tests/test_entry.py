import duckdb
import pytest

import __spark_entry__ as entry
from eventloom import entries

DIR = "/root/testdata/sf0.001"


def key(v):
    return "~" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for name in ("events", "orders", "lineitem", "part", "documents", "labels", "pages"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(entries.queries()))
def test_query(spark, tables, name):
    df = entries.queries()[name](spark, DIR)
    want = tables.sql(entries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    rows = lambda rs: sorted(tuple(map(key, r)) for r in rs)
    assert rows(df.select(*cols).collect()) == rows(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
