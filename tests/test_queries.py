"""Every registered query against its DuckDB oracle on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from schemasight.oracle import ORACLE
from schemasight.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


#: Queries whose result may be empty.
EMPTY = {"gate_empty"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return con


def rows(df, columns):
    show = lambda x: None if pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted((tuple(show(x) for x in r) for r in df[columns].itertuples(index=False)), key=str)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLE[name]).df()
    assert len(got) or name in EMPTY
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
