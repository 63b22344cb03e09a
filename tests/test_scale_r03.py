"""What is read once, dealt once and kept in memory (findings of round 3)."""

import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from churnlab import schemas
from churnlab.operators import model, ordered, splits
from churnlab.plans import flows
from churnlab.plans.catalog import all_queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    day = datetime.datetime(2000, 7, 1)
    orders = [(k, k % 4, "F", 10.0 * k, day, "1-URGENT") for k in range(12)]
    lines = [(k, n, 1.0 * n, 5.0 * k, 0.01 * n, 0.01 * k, day) for k in range(12) for n in range(1, 6)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                                  "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                 "l_discount double, l_tax double, l_shipdate timestamp_ntz").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(k, f"c{k % 7}" if k % 5 else None) for k in range(40)],
                          "c_custkey long, c_name string").write.parquet(f"{d}/customer.parquet")
    return d


@pytest.mark.parametrize("query", ["cl2_fill_prices_with_median", "cl3_negative_fixed_prices_to_median",
                                   "cl3_negatives_to_median_two_pass", "in5_describe_prices", "ag9_median_prices"])
def test_price_history_is_joined_once(spark, tables, query):
    out = all_queries()[query](spark, tables)
    files = out.inputFiles()
    assert files and all("/stages/prices-" in f for f in files)
    assert out.count() == {"in5_describe_prices": 6, "ag9_median_prices": 1}.get(query, 60)


def test_flow_stores_the_history_before_its_medians(spark, monkeypatch):
    names, store = [], flows.materialize
    monkeypatch.setattr(flows, "materialize", lambda df, name: names.append(name) or store(df, name))
    rows = spark.createDataFrame([(1, "2015-01-01", *[float(i) for i in range(6)])],
                                 ["id", "price_date", *schemas.PRICE_MEASURES])
    assert flows.price_history(rows).count() == 1
    assert names == ["prices", "price_history"]


def test_sparse_vectors_are_not_spread_out(spark, tables):
    out = all_queries()["fe5_one_hot_many"](spark, tables)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "size(UDF(" not in plan
    rows = {r["c_custkey"]: (r["position"], r["size"]) for r in out.collect()}
    assert rows == {k: (k % 7, 8) for k in range(40) if k % 5}


def test_whole_rows_are_dealt_once_into_ranges_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(ordered, "ROWS_NUMBERED", 50)
    stored, store = {}, ordered.materialize

    def keep(df, name):
        assert name not in stored
        stored[name] = store(df, name)
        return stored[name]

    monkeypatch.setattr(ordered, "materialize", keep)
    rows = [(i % 90, (None, 0, 1)[i % 3], i % 2) for i in range(900)]      # keys repeat, some whole rows too
    df = spark.createDataFrame(rows, "id int, churn int, x int")
    got = splits.stratified_folds(df, "churn", ["id"], 3)
    assert set(stored["numbered_ranges"].columns) == {"id", "churn", "x", "_pid", "_at"}
    assert stored["numbered_ranges"].groupBy("_pid").count().agg(F.max("count")).first()[0] < 200
    w = Window.partitionBy("churn").orderBy(splits.key_hash(["id"]), "id", F.xxhash64("id", "churn", "x"))
    want = df.withColumn("fold", ((F.row_number().over(w) - 1) % 3).cast("int"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_fits_that_memory_does_not_hold_wait(spark, monkeypatch):
    assert model.fits_at_once(10 * 10**9, 24_000_000, 45) == 1
    assert model.fits_at_once(10 * 10**9, 1_000_000, 45) > 3
    assert model.fits_at_once(0, 0, 0) == 1
    assert model.storage_bytes(spark) > 10**8
    together, run = [], model.side_by_side
    monkeypatch.setattr(model, "storage_bytes", lambda spark: 1)
    monkeypatch.setattr(model, "side_by_side", lambda spark, tasks, n=None: together.append(n) or run(spark, tasks, n))
    df = spark.createDataFrame([(i, i % 2, float(i % 2 + i % 5), i // 2 % 3) for i in range(120)], "id int, churn int, x double, fold int")
    params = {"learning_rate": 0.1, "max_depth": 2, "n_estimators": 1}
    aucs = model.cross_validate(df, ["x"], params)[0]
    model.grid_search(df, ["x"], {k: [v] for k, v in params.items()}, parallelism=4)
    assert together == [1, 1]
    assert aucs.count() == 3


def test_a_task_of_a_fit_holds_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(model, "ROWS_PER_TASK", 50)
    df = spark.createDataFrame([(i, i % 2, float(i % 2 + i % 5)) for i in range(600)], "id int, churn int, x double").coalesce(1)
    assert model.in_small_partitions(df, 40).rdd.getNumPartitions() == 1
    dealt = model.in_small_partitions(df, 600)
    assert dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 100
    assert sorted(dealt.collect()) == sorted(df.collect())
    seen, deal = [], model.in_small_partitions
    monkeypatch.setattr(model, "in_small_partitions", lambda df, rows: seen.append(rows) or deal(df, rows))
    fitted = model.fit(df, ["x"], {"learning_rate": 0.1, "max_depth": 2, "n_estimators": 1})
    assert seen == [600]
    assert model.predict(fitted, df).count() == 600


def test_fits_over_folds_read_their_files_and_shuffle_no_row(spark, monkeypatch):
    monkeypatch.setattr(model, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(model, "ROWS_PER_FILE", 10, raising=False)
    fitted, gbt = [], model.gbt

    class Fits:
        def __init__(self, est):
            self.est = est

        def fit(self, data):
            plan = data._jdf.queryExecution().executedPlan().toString()
            sizes = [r["count"] for r in data.groupBy(F.spark_partition_id()).count().collect()]
            fitted.append(("Exchange" in plan, max(sizes), sum(sizes), "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan))
            return self.est.fit(data)

    monkeypatch.setattr(model, "gbt", lambda *a, **k: Fits(gbt(*a, **k)))
    # rows without a fold train every model of a validation and none of a search; whole rows repeat
    rows = [(i % 500, i % 2, float(i % 2 + i % 5), None if i % 100 == 0 else i // 2 % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, churn int, x double, fold int").coalesce(1)
    params = {"learning_rate": 0.1, "max_depth": 2, "n_estimators": 1}
    aucs, roc, _ = model.cross_validate(df, ["x"], params)
    table, _ = model.grid_search(df, ["x"], {k: [v] for k, v in params.items()})
    assert not any(shuffled for shuffled, *_ in fitted)
    assert all(most <= 70 for _, most, *_ in fitted)
    of = [sum(r[3] == f for r in rows) for f in range(3)]
    assert sorted(n for _, _, n, _ in fitted[:3]) == sorted(600 - n for n in of)
    assert sorted(n for _, _, n, _ in fitted[3:]) == sorted(594 - n for n in of)
    assert len(fitted) == 6 and all(pruned for *_, pruned in fitted)
    assert aucs.count() == 3 and table.count() == 1
    assert {f.name: f.dataType.simpleString() for f in roc.schema}["fold"] == "int"
