"""Every registered query with oracle SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from chirplake.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame, columns: list[str]) -> list[str]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(v) if hasattr(v, "__float__") and not isinstance(v, (bool, str)) else str(v)

    return sorted(repr(tuple(plain(v) for v in r)) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    wanted = db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(wanted, columns)
