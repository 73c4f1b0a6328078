"""Every query with an oracle against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from rillhouse.plans.queries import QUERIES, SQL


def normal(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf), duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    rows = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    found = [r.asDict() for r in got.collect()]
    assert sorted(got.columns) == sorted(names) and len(found) == len(rows) > 0
    key = lambda r: tuple(str(r[c]) for c in sorted(names))
    assert sorted(map(key, found)) == sorted(map(key, rows))
