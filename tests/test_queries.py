"""Every registered query with SQL gives DuckDB's rows, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__
from skeinframe.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or x != x else round(float(x), 4) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)
    return sorted((tuple(plain(x) for x in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    mine, theirs = registry.queries()[name](spark, DATA).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = rows(mine), rows(theirs)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-3) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", ["arith_basic", "arith_exponential"])
def test_rows_with_infinite_values_by_text(spark, duck, tmp_path, name):
    """The SQL's rows exactly, as multisets by text, which tells negative zeros from others."""
    registry.queries()[name](spark, DATA).write.parquet(f"file://{tmp_path}/got")
    names = [c[0] for c in duck.execute(f"DESCRIBE {registry.oracle_sql()[name]}").fetchall()]
    texts = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in names)
    want, got = f"SELECT {texts} FROM ({registry.oracle_sql()[name]})", f"SELECT {texts} FROM '{tmp_path}/got/*.parquet'"
    for a, b in ((want, got), (got, want)):
        assert duck.execute(f"{a} EXCEPT ALL {b}").fetchall() == []


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
