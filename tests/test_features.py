import math

import pytest

from churnlab.functions import dates as D
from churnlab.functions import scalar as S
from churnlab.operators import features


def test_price_window_means_strict_bounds(spark):
    data = [(1, "2015-01-01", 1.0), (1, "2015-06-01", 2.0), (1, "2015-06-02", 4.0), (1, "2015-10-01", 8.0),
            (1, "2015-12-01", 16.0), (2, "2015-02-01", 5.0)]
    df = spark.createDataFrame(data, "id int, price_date string, p double")
    out = {r["id"]: r for r in features.price_window_means(df, ["p"]).collect()}
    assert out[1]["mean_year_p"] == 31.0 / 5
    assert out[1]["mean_6m_p"] == (4.0 + 8.0 + 16.0) / 3   # 2015-06-01 excluded
    assert out[1]["mean_3m_p"] == 16.0                    # 2015-10-01 excluded
    assert out[2]["mean_6m_p"] is None


def test_tenure_and_months_truncate_toward_zero(spark):
    df = spark.createDataFrame([("2010-01-01", "2015-12-31", "2016-02-15")], "a string, e string, r string")
    t = features.tenure(df, "a", "e").first()["tenure"]
    assert t == int(((D.DAYS_PER_YEAR * 0) + 2190) / D.DAYS_PER_YEAR)
    m = features.months_features(df, {"months_activ": "a", "months_end": "r"}).first()
    assert m["months_activ"] == int(2191 / D.DAYS_PER_MONTH)
    assert m["months_end"] == -int(-45 / D.DAYS_PER_MONTH) == 1  # truncation toward zero, then negated


def test_one_hot_names_baseline_and_rows(spark):
    df = spark.createDataFrame([(1, "foo_long"), (2, None), (3, "bar_long"), (4, "foo_long")], "id int, c string")
    out = features.one_hot(df, "c", "channel", width=11, null_label="null_channels", drop_label="channel_nul")
    assert out.columns == ["id", "channel_bar", "channel_foo"]
    for r in out.collect():
        assert r["channel_bar"] + r["channel_foo"] in (0, 1)
    with pytest.raises(ValueError):
        features.one_hot(df, "c", "channel", width=8)


def test_fold_rare_threshold_75_76(spark):
    data = [("rare",)] * 75 + [("common",)] * 76 + [(None,)] * 3
    df = spark.createDataFrame(data, "a string")
    out = features.fold_rare(df, "a", 75, "null_activity", null_label="null_activity")
    counts = {r["a"]: r["count"] for r in out.groupBy("a").count().collect()}
    assert counts == {"null_activity": 78, "common": 76}
    joined = features.fold_rare(df, "a", 75, "null_activity", null_label="null_activity")
    assert {r["a"]: r["count"] for r in joined.groupBy("a").count().collect()} == counts


def test_log_features_and_flag(spark):
    df = spark.createDataFrame([(-5.0, "t"), (9.0, "f"), (None, "x")], "x double, g string")
    out = features.encode_flag(features.log_features(df, ["x"]), "g").collect()
    assert out[0]["x"] is None and abs(out[1]["x"] - 1.0) < 1e-12
    assert [r["g"] for r in out] == [1, 0, None]


def test_drop_correlated(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 1, float((i * 7) % 5)) for i in range(30)], "a double, b double, c double")
    assert features.correlated_columns(df, ["a", "b", "c"], 0.9) == ["b"]
    assert features.drop_correlated(df, ["a", "b", "c"]).columns == ["a", "c"]


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(2.5, 0.04, "2016-01-01")], "x double, y double, d string")
    r = df.select(S.round_half_even("x").alias("a"), S.bar_label("y").alias("b"), S.clamp(S.negate("x")).alias("c"),
                  D.month_tick_label(D.parse_date("d")).alias("l")).first()
    assert r["a"] == 2.0 and r["b"] is None and r["c"] == 0.0 and r["l"] == "J\n2016"
    assert math.isclose(df.select(S.log10p1("x")).first()[0], math.log10(3.5))
    assert spark.createDataFrame([(None,)], "x double").select(S.clamp("x")).first()[0] is None


def test_too_many_categories_raise_and_the_vector_form_equals_the_columns(spark):
    from pyspark.ml.functions import vector_to_array
    from churnlab.operators import model
    df = spark.createDataFrame([(i, v, float(i)) for i, v in enumerate(["b", None, "a", "c", "a", "n"])], "id long, c string, x double")
    with pytest.raises(ValueError, match="one_hot_vector"):
        features.one_hot(df, "c", "p", max_categories=3)
    wide = features.one_hot(df, "c", "p", null_label="n", drop_label="p_n")
    vector = features.one_hot_vector(df, "c", "p", "n", "p_n")
    cols, names = model.feature_columns(vector), None
    assert cols == ["x", "p"]                       # the category number is no input
    names = model.feature_names(vector, cols)
    assert names == ["x", "p_a", "p_b", "p_c"] == model.feature_columns(wide)
    for rows in zip(*(sorted(f.select("id", vector_to_array("f")).collect()) for f in (
            model.assembler(cols, "f").transform(vector), model.assembler(names, "f").transform(wide))), strict=True):
        assert rows[0] == rows[1]
    filled, after = model.prepare_features(vector, cols)
    assert after == cols and filled.count() == 6


def test_flow_in_vector_form_gives_the_same_model(spark):
    from dataclasses import replace
    from conftest import SF001
    from churnlab.operators import model
    from churnlab.plans import flows
    from churnlab.sources import fixtures as fx
    cfg = flows.FIXTURE_CONFIG
    found = []
    for vector in (False, True):
        specs = tuple(replace(s, vector=vector, width=None, rare_threshold=3) for s in cfg.one_hot)
        m = flows.customer_matrix(fx.customers(spark, SF001), fx.churn_flags(spark, SF001), replace(cfg, one_hot=specs, correlated_drop=()))
        data, cols = model.prepare_features(m, model.feature_columns(m))
        names = model.feature_names(data, cols)
        # the same inputs in the same order: dummies by name
        fitted = model.fit(data, cols, {"max_depth": 3, "n_estimators": 3})
        counts = {r.feature: r.splits for r in model.split_counts(fitted, names).collect()}
        found.append((set(names), counts))
    assert found[0][0] == found[1][0] and sum(found[0][1].values()) == sum(found[1][1].values())
