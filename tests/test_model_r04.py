"""The whole search, and what a fit reads (findings of round 4)."""

import pytest
from pyspark.sql import functions as F

from churnlab.operators import model
from churnlab.plans import q_model
from churnlab.plans.catalog import all_oracle_sql, all_queries


@pytest.fixture
def asked(spark, monkeypatch):
    """What the registered search asks of ``grid_search`` and ``cross_validate``: (candidates, parameters of the refit)."""
    rows = [(i, i % 2, float(i % 2), i // 2 % 3, 0) for i in range(12)]
    data = spark.createDataFrame(rows, "id int, churn int, x double, fold int, is_test int")
    calls = {"grid": [], "refit": []}

    def search(data, columns, grid=None, **kw):
        calls["grid"].append(model.param_grid(grid))
        found = [(i, str(c), str(model.unmapped_params(c)), 0.9, i + 1) for i, c in enumerate(model.param_grid(grid))]
        return spark.createDataFrame(found, "candidate int, params string, unmapped string, mean_auc double, rank int"), model.param_grid(grid)[2]

    def refit(data, columns, params, **kw):
        calls["refit"].append(params)
        return spark.createDataFrame([(f, 0.9, 0.8) for f in range(3)], "fold int, auc_train double, auc_test double"), None, None

    monkeypatch.setattr(q_model, "_training", lambda spark, sf: (data, ["x"]))
    monkeypatch.setattr(model, "grid_search", search)
    monkeypatch.setattr(model, "cross_validate", refit)
    monkeypatch.setattr(model, "split_counts", lambda m, cols: spark.createDataFrame([("x", 3, 1)], "feature string, splits long, rank int"))
    return calls


WHOLE = [{"subsample": 0.7, "scale_pos_weight": 1, "n_estimators": 1100, "min_child_weight": 1, "max_depth": d,
          "learning_rate": r, "gamma": 4.0, "colsample_bytree": 0.6} for d in (12, 13, 14) for r in (0.005, 0.01)]


def test_search_fits_the_references_trees(spark, asked):
    import duckdb
    out = all_queries()["ml13_ml15_grid_search"](spark, "")
    assert asked["grid"] == [WHOLE]
    want = duckdb.connect().execute(all_oracle_sql()["ml13_ml15_grid_search"]).fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert sorted(w[1] for w in want) == sorted(map(str, WHOLE))


def test_best_refit_follows_the_whole_search(spark, asked):
    out = all_queries()["ml16_ml17_best_refit_and_importance"](spark, "")
    assert asked == {"grid": [WHOLE], "refit": [WHOLE[2]]}
    assert sorted(map(tuple, out.collect())) == [(f, True, True, True) for f in range(3)]


def test_fits_of_a_small_table_have_few_tasks(spark, monkeypatch):
    assert model.tasks_of_fit(0, 8) == 1 and model.tasks_of_fit(40_000, 8) == 1
    assert model.tasks_of_fit(8 * model.ROWS_WORTH_A_TASK, 8) == 8 == model.tasks_of_fit(8 * model.ROWS_PER_TASK, 8)
    assert model.tasks_of_fit(8 * model.ROWS_PER_TASK + 1, 8) == 16
    parts, gbt = [], model.gbt

    class Fits:
        def __init__(self, est):
            self.est = est

        def fit(self, data):
            parts.append((data.rdd.getNumPartitions(), data.count()))
            return self.est.fit(data)

    monkeypatch.setattr(model, "gbt", lambda *a, **k: Fits(gbt(*a, **k)))
    df = spark.createDataFrame([(i, i % 2, float(i % 2 + i % 5), i // 2 % 3) for i in range(240)],
                               "id int, churn int, x double, fold int").repartition(4)
    table, _ = model.grid_search(df, ["x"], {"max_depth": [2], "n_estimators": [1]})
    assert parts == [(1, 160)] * 3 and table.count() == 1


def test_a_fit_reads_stored_features_and_shuffles_no_row(spark, monkeypatch):
    monkeypatch.setattr(model, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(model, "ROWS_PER_FILE", 10)
    fitted, deal = [], model.in_small_partitions

    def dealt(df, rows):
        out = deal(df, rows)
        fitted.append((out.columns, rows, "Exchange" in out._jdf.queryExecution().executedPlan().toString(),
                       [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()],
                       all("/fit_features-" in f for f in out.inputFiles())))
        return out

    monkeypatch.setattr(model, "in_small_partitions", dealt)
    # one large split; keys and whole rows repeat
    df = spark.createDataFrame([(i % 500, i % 2, float(i % 2 + i % 5)) for i in range(600)], "id int, churn int, x double").coalesce(1)
    m = model.fit(df, ["x"], {"learning_rate": 0.1, "max_depth": 2, "n_estimators": 2})
    (columns, rows, shuffled, sizes, stored), = fitted
    assert columns == ["churn", model.WEIGHT, "features"] and rows == 600 and stored
    assert not shuffled and sum(sizes) == 600 and max(sizes) <= 70
    scored = model.predict(m, df, ["id", "churn"])
    assert scored.count() == 600 and scored.where("p_churn < 0 or p_churn > 1").count() == 0


def test_report_stores_the_validations_rows_once(spark, monkeypatch):
    import datetime

    from churnlab.operators import splits
    from churnlab.plans import flows
    names, store = [], model._store_for_fits
    monkeypatch.setattr(model, "_store_for_fits", lambda df, fold_col, name, *a: names.append(name) or store(df, fold_col, name, *a))
    # keys repeat
    rows = [(i % 80, datetime.date(2000, 1, 1 + i % 9), i % 80 % 2, float(i % 80 % 2 + i % 5), float(i % 7)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, price_date date, churn int, x1 double, x2 double")
    base = {"learning_rate": 0.1, "max_depth": 2, "n_estimators": 1}
    for weight, want in ((1, ["cv_features", "search_features"]), (2, ["cv_features", "search_features", "cv_features"])):
        names.clear()
        out = flows.model_report(df, {**base, "scale_pos_weight": weight}, {k: [v] for k, v in base.items()})
        assert names == want and out["cv_fold_auc"].count() == out["best_fold_auc"].count() == 3
    folded = splits.stratified_folds(df, "churn", ["id", "price_date"], 3)
    other, deeper = {**base, "n_estimators": 2}, {**base, "max_depth": 3}
    stored = model.store_folds(folded, ["x1", "x2"], other)
    shared, alone = (sorted(map(tuple, model.cross_validate(folded, ["x1", "x2"], deeper, stored=s)[0].collect())) for s in (stored, None))
    assert shared == alone and len(shared) == 3
