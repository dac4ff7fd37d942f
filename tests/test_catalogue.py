"""Every query of the core catalogue against its SQL."""

import math

import pytest

from tesserae.queries import ORACLES, QUERIES, flagship

from .oracle import connection, same


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, con, name):
    same(QUERIES[name](spark, sf), con, ORACLES[name])


@pytest.mark.parametrize("balances", [[0.0, -0.0, 0.01, -0.01, None], [1e-60, -1e-60, 1e-45, -1e-45, 3.4e38], [math.inf, -math.inf, math.nan, -math.nan]])
def test_float_image_of_odd_balances(spark, sf, tmp_path, balances):
    """A rounded balance may be -0.0, of which there are none in the small tables."""
    spark.createDataFrame(list(enumerate(balances)), "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = connection(sf)
    con.execute(f"CREATE OR REPLACE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    same(QUERIES["float_order_image"](spark, str(tmp_path)), con, ORACLES["float_order_image"])


def test_without_sql(spark, sf):
    rows = {r.doc_id: r.json for r in QUERIES["json_write_nodefaults"](spark, sf).collect()}
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for i, text in rows.items():
        quality, toxic = labels[i]
        assert ('"quality":1' in text) == (quality == 1) and ('"toxic":true' in text) == (toxic == 1) and '":0' not in text and "false" not in text


def test_flagship(spark, sf):
    assert flagship(spark, sf).columns == ["id"]
    assert flagship(spark, sf).count() <= 100


def test_filter_reaches_the_scan(spark, sf):
    plan = QUERIES["sel_mutex_eq"](spark, sf)._jdf.queryExecution().toString()
    assert "EqualTo(o_orderstatus,F)" in plan and "o_totalprice" not in plan.split("ReadSchema")[1]


def test_entry():
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
