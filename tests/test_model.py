import pytest
from pyspark.sql import functions as F

from churnlab.operators import metrics, model, splits


def _data(spark, n=600):
    df = spark.range(n).select(F.col("id"), (F.col("id") % 2).cast("int").alias("churn"))
    return df.select("id", "churn",
                     (F.col("churn") * 2.0 + F.rand(1) * 1.5).alias("x1"),
                     F.rand(2).alias("x2"),
                     F.when(F.col("id") % 7 == 0, None).otherwise(F.rand(3)).alias("x3"))


def test_fit_predict_auc_and_repeatable(spark):
    data, cols = model.prepare_features(_data(spark), ["x1", "x2", "x3"])
    assert "x3_missing" in cols
    train, test = splits.split(data, ["id"])
    params = {"learning_rate": 0.1, "max_depth": 3, "n_estimators": 5}
    m1 = model.fit(train, cols, params)
    p1 = model.predict(m1, test)
    auc = metrics.auc(p1.select(F.col("churn").alias("label"), F.col("p_churn").alias("score"))).first()["auc"]
    assert auc > 0.9
    p2 = model.predict(model.fit(train, cols, params), test)
    a = {r["id"]: r["p_churn"] for r in p1.collect()}
    b = {r["id"]: r["p_churn"] for r in p2.collect()}
    assert a == b


def test_param_mapping_and_grid():
    mapped, unmapped = model.xgb_to_gbt(model.param_grid()[0])
    assert mapped["maxDepth"] == 12 and mapped["maxIter"] == 1100 and "gamma" in unmapped
    assert len(model.param_grid()) == 6


def test_cv_grid_search_and_importance(spark):
    data, cols = model.prepare_features(_data(spark, 300), ["x1", "x2", "x3"])
    folded = splits.stratified_folds(data, "churn", ["id"], 3)
    aucs, roc, last = model.cross_validate(folded, cols, {"max_depth": 2, "n_estimators": 3})
    assert aucs.count() == 3 and roc.where("rank = 0").count() == 3
    grid = {"max_depth": [2, 3], "learning_rate": [0.1], "n_estimators": [3]}
    table, best = model.grid_search(folded, cols, grid, parallelism=2)
    assert table.count() == 2 and best["max_depth"] in (2, 3)
    imp = {r["feature"]: r["splits"] for r in model.split_counts(last, cols).collect()}
    assert imp.get("x1", 0) > 0


def test_grid_search_with_other_fold_counts(spark):
    data, cols = model.prepare_features(_data(spark, 200), ["x1", "x2"])
    for k in (2, 4):
        folded = splits.stratified_folds(data, "churn", ["id"], k)
        table, _ = model.grid_search(folded, cols, {"max_depth": [2], "n_estimators": [2], "gamma": [4.0]}, k=k)
        row = table.first()
        assert row["mean_auc"] > 0.8 and "gamma" in row["unmapped"]


def test_parameters_that_do_not_fit_raise_and_weights_count(spark):
    for bad in ({"max_depth": 40}, {"min_child_weight": 1.5}):
        with pytest.raises(ValueError):
            model.xgb_to_gbt(bad)
    assert model.unmapped_params({"gamma": 4, "max_depth": 3}) == {"gamma": 4}
    data, cols = model.prepare_features(_data(spark, 400).select("id", "churn", "x2"), ["x2"])
    means = [model.predict(model.fit(data, cols, {"max_depth": 2, "n_estimators": 5, "scale_pos_weight": w}), data)
             .agg(F.avg("p_churn")).first()[0] for w in (1, 8)]
    assert means[1] > means[0] + 0.1


def test_nan_is_flagged_like_null(spark):
    df = spark.createDataFrame([(1, 1.0, float("nan")), (2, 2.0, 3.0)], "id long, a double, b double")
    out, cols = model.prepare_features(df, ["a", "b"])
    assert cols == ["a", "b", "b_missing"] and [r["b_missing"] for r in out.orderBy("id").collect()] == [1.0, 0.0]


def test_exact_auc_orders_what_binning_ties(spark):
    """20,000 distinct scores: swapping neighbours inside the thinned curve's steps is seen only by the exact area."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    n = 20_000
    df = spark.range(n, numPartitions=4).select((F.col("id") >= n // 2).cast("double").alias("label"), F.col("id").cast("double").alias("good"))
    # the two rows beside the border change places
    swapped = F.when(F.col("good") == n // 2 - 1, n // 2).when(F.col("good") == n // 2, n // 2 - 1).otherwise(F.col("good"))
    df = df.withColumn("worse", swapped.cast("double")).cache()
    exact = [model.ExactAUC("label", c).evaluate(df) for c in ("good", "worse")]
    assert exact[0] == 1.0 and exact[1] == 1 - 1 / (n // 2) ** 2
    binned = [BinaryClassificationEvaluator(labelCol="label", rawPredictionCol=c).evaluate(df) for c in ("good", "worse")]
    assert exact[0] > exact[1] and abs(binned[0] - binned[1]) != exact[0] - exact[1]
    one = df.where("label = 1")
    assert model.ExactAUC("label", "good").evaluate(one) != model.ExactAUC("label", "good").evaluate(one)   # NaN
    df.unpersist()


def test_folds_side_by_side_equal_the_loop(spark):
    data, cols = model.prepare_features(_data(spark, 300), ["x1", "x2", "x3"])
    folded = splits.stratified_folds(data, "churn", ["id"], 3)
    runs = [model.cross_validate(folded, cols, {"max_depth": 2, "n_estimators": 3}, parallelism=p) for p in (1, None)]
    aucs = [sorted(tuple(r) for r in a.collect()) for a, _, _ in runs]
    assert aucs[0] == aucs[1] and len(aucs[0]) == 3
    assert model.side_by_side(spark, []) == []
    with pytest.raises(ZeroDivisionError):
        model.side_by_side(spark, [lambda: 1, lambda: 1 / 0])


def test_rounding_noise_is_no_split(spark):
    """Equal rows are not split, however often boosting goes over them."""
    df = spark.createDataFrame([(i, i % 2, float(i % 2), float(i)) for i in range(60)], "id long, churn int, x1 double, x2 double")
    counts = model.split_counts(model.fit(df, ["x1", "x2"], {"max_depth": 4, "n_estimators": 6}), ["x1", "x2"])
    assert [tuple(r) for r in counts.collect()] == [("x1", 6, 1)]
