"""Queries do the whole job: no cap below the reference's, no subset of ids, no part of the pairs."""

import os

import duckdb
import pytest
from test_catalog import SF, TABLES

from gridloom import jobs
from gridloom.plans import catalog


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    """20,003 orders."""
    at = tmp_path_factory.mktemp("tables")
    con = duckdb.connect()
    con.sql("CREATE TABLE orders AS SELECT i * 3 + 1 AS o_orderkey, i * 7 % 1500 + 1 AS o_custkey FROM range(20003) r(i)")
    con.sql(f"COPY orders TO '{at}/orders.parquet'")
    return str(at), con


def test_all_lines_up_to_the_cap_and_the_count_of_the_rest(spark, tables):
    at, con = tables
    got = catalog.QUERIES["degraded_lines"](spark, at).collect()
    listed = {r["id"]: r["line"] for r in got if r["id"] is not None}
    assert list(listed) == [k for (k,) in con.sql("SELECT o_orderkey FROM orders ORDER BY 1 LIMIT 20000").fetchall()]
    assert listed[1] == "[Degraded] z=12 x=1 y=1 reason=http_503 filled_from=z11"
    assert [r["line"] for r in got if r["id"] is None] == ["[Degraded] … 3 more not listed"]


def test_no_row_of_the_rest_where_all_lines_are_listed(spark, tables, tmp_path):
    tables[1].sql(f"COPY (SELECT * FROM orders LIMIT 700) TO '{tmp_path}/orders.parquet'")
    got = catalog.QUERIES["degraded_lines"](spark, str(tmp_path)).collect()
    assert len(got) == 700 and all(r["id"] is not None for r in got)


def test_plans_of_too_many_tiles_are_refused(spark, monkeypatch):
    assert jobs.MAX_TILES == 2_000_000
    monkeypatch.setattr(jobs, "MAX_TILES", 12)
    with pytest.raises(ValueError, match="more than 12 tiles"):
        jobs.plan(spark, 46.99, 47.51, 7.49, 8.01, [30, 90])
    monkeypatch.setattr(jobs, "MAX_TILES", 13)
    assert jobs.plan(spark, 46.99, 47.51, 7.49, 8.01, [30, 90])["tile_count"] == 13


#: What every row of a table must have a part in; see the queries of these names.
WHOLE = {
    "float_mean": ("lineitem", "count(DISTINCT l_suppkey)"),
    "cross_links": ("supplier, customer", "count(*)"),
    "repair_mask": ("orders", "count(DISTINCT o_orderkey % 500)"),
    "window_chunks": ("orders", "count(DISTINCT CASE WHEN o_custkey % 200 > 0 AND o_orderkey % 90 > 0 THEN o_orderkey END)"),
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(WHOLE))
def test_all_ids_are_taken(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    table, counted = WHOLE[name]
    got = catalog.QUERIES[name](spark, SF)
    n = got.select("id").distinct().count() if name == "window_chunks" else got.count()
    assert n == con.sql(f"SELECT {counted} FROM {table}").fetchall()[0][0]
