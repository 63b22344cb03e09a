"""Plan checks: the operators stay JVM-side, push filters into the scan and shuffle once."""

import os

from churnlab.operators import features, filters, rates
from conftest import SF01


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_pushed_into_parquet_scan(spark):
    c = spark.read.parquet(os.path.join(SF01, "customer.parquet"))
    plan = _plan(filters.equals(c, "c_mktsegment", "BUILDING").select("c_custkey"))
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)]" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan


def test_crosstab_single_shuffle_no_python(spark):
    o = spark.read.parquet(os.path.join(SF01, "orders.parquet")).withColumnRenamed("o_custkey", "id")
    o = o.selectExpr("id", "o_orderstatus", "CAST(o_orderpriority = '1-URGENT' AS INT) AS churn")
    plan = _plan(rates.crosstab(o, "o_orderstatus"))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan


def test_price_windows_one_scan_one_shuffle(spark):
    li = spark.read.parquet(os.path.join(SF01, "lineitem.parquet"))
    p = li.selectExpr("l_orderkey AS id", "CAST(CAST(l_shipdate AS DATE) AS STRING) AS price_date",
                      "l_extendedprice AS a", "l_tax AS b")
    plan = _plan(features.price_window_means(p, ["a", "b"], windows={"year": None, "6m": "1999-01-01"}))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("FileScan parquet") == 1
