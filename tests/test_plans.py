"""Every plan that SQL can express against DuckDB on the same tables; the others yield rows."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from corvane.plans import registry
from corvane.session import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(map(plain, x))
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.integer, np.floating)) or type(x).__name__ == "Decimal":
        return repr(round(float(x), 6))
    if hasattr(x, "isoformat"):
        return str(pd.Timestamp(x).tz_localize(None))
    return x


def rows(columns, data):
    at = [list(columns).index(c) for c in sorted(columns)]
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_oracle(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    found = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_yields_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
