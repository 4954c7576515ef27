"""Every query with SQL gives DuckDB's rows."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SQL = {k: v for k, v in entry.oracle_sql().items() if not k.startswith("op") and k != "pipeline"}


def _key(row):
    return tuple((v is not None, str(type(v)) if not isinstance(v, int | float) else "", v if isinstance(v, int | float) else str(v)) for v in row)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def same(spark, db, sf_dir, name, sql):
    df = entry.queries()[name](spark, sf_dir)
    want = db.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=_key)
    expected = sorted(map(tuple, db.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()), key=_key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        for x, y in zip(a, b, strict=True):
            if isinstance(x, float) and isinstance(y, float):
                assert x == y or math.isclose(x, y, abs_tol=2e-6, rel_tol=1e-12), (a, b)
            else:
                assert x == y, (a, b)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, sf_dir, name):
    same(spark, db, sf_dir, name, SQL[name])
