"""Every query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from voxlake.plans import PLANS
from voxlake.session import TABLES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(df):
    def one(v):
        if not isinstance(v, (list, np.ndarray)) and pd.isna(v):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        if isinstance(v, (int, float, np.integer, np.floating)) or type(v).__name__ == "Decimal":
            return f"{float(v):.4f}"
        return str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(PLANS.oracle))
def test_query_equals_sql(spark, duck, name):
    got, want = plain(PLANS.queries[name](spark, DATA).toPandas()), plain(duck.sql(PLANS.oracle[name]).df())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(PLANS.queries) - set(PLANS.oracle)))
def test_query_without_sql_gives_the_same_rows_again(spark, name):
    first = plain(PLANS.queries[name](spark, DATA).toPandas())
    assert first and first == plain(PLANS.queries[name](spark, DATA).toPandas())
