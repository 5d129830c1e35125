"""Every query against the same question in DuckDB, on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from gridloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return "null"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return repr(float(v))
    return str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple(plain(v) for v in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_probe_has_a_row_for_every_file(spark):
    got = catalog.QUERIES["probe_facts"](spark, SF).toPandas()
    bad = got[got["path"].str.extract(r"(\d+)")[0].astype(int) % 5 == 0]
    assert len(got) == 10 and not bad["ok"].any() and bad["reason"].notna().all()
    good = got[got["ok"]].iloc[0]
    assert (good["width"], good["height"], good["epsg"], good["overviews"], good["compression"]) == (48, 40, 4326, 1, "deflate")
