"""Every catalogue query against its SQL on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lumencube.plans.registry import CATALOGUE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(df):
    def one(v):
        if pd.isna(v):
            return None
        return float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted((tuple(map(one, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_same_as_sql(spark, db, name):
    q = CATALOGUE[name]
    mine, sql = q.run(spark, SF).toPandas(), db.execute(q.sql).df()
    assert sorted(mine.columns) == sorted(sql.columns)
    assert plain(mine) == plain(sql)
