"""Every registered query of the core against its SQL in DuckDB at the smallest scale."""

import math

import duckdb
import pandas as pd
import pytest

from lorewell.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def one(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return format(v, ".9g") if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].map(one)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    if name in registry.ORACLES:
        pd.testing.assert_frame_equal(plain(got), plain(duck.execute(registry.ORACLES[name]).df()))
    else:
        assert len(got)


def test_entry_names_every_query():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())
