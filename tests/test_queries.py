"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import pandas as pd
import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from corpusloom.plans import catalogue  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(df):
    columns = sorted(df.columns)

    def cell(x):
        if x is None or (not isinstance(x, (list, dict, str)) and pd.isna(x) is True):
            return "null"
        number = isinstance(x, (int, float)) and not isinstance(x, bool)
        return repr(round(float(x), 6)) if number and math.isfinite(x) else str(x)

    return columns, sorted(tuple(cell(getattr(x, "item", lambda x=x: x)()) for x in r) for r in df[columns].itertuples(index=False, name=None))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name in catalogue.ORACLES:
        assert rows(got) == rows(duck.sql(catalogue.ORACLES[name]).df())
    else:
        assert len(got.columns)
