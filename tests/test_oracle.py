"""Every registered query of the library against its SQL; those of the text operators have tests of their own."""

import math

import duckdb
import pytest

from tidewell import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"create view {name} as from '{sf_dir}/{name}.parquet'")
    return connection


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def ordered(rows, columns, names):
    at = [names.index(c) for c in columns]
    return sorted((tuple(normal(r[i]) for i in at) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_its_sql(spark, sf_dir, db, name):
    found = catalog.QUERIES[name](spark, sf_dir)
    result = db.execute(catalog.ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(found.columns)
    columns = sorted(names)
    assert ordered(found.collect(), columns, found.columns) == ordered(result.fetchall(), columns, names)


def test_flagship(spark, sf_dir):
    page = catalog.flagship(spark, sf_dir)
    rows = page.collect()
    assert len(rows) == 10 and all(r.customer.c_custkey == r.owner for r in rows)
    assert [r.total for r in sorted(rows, key=lambda r: r["rank"])] == sorted((r.total for r in rows), reverse=True)


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from tidewell.plans import list_queries

    plan = list_queries.Q02_count_filtered(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan and "StringContains(o_orderpr" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_orderpriority:string>" in plan
    page = list_queries.Q07_page_half_open(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in page


@pytest.mark.parametrize("name", ["Q17_map_left_join", "Q57_two_level_nest"])
def test_no_group_is_collected(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
