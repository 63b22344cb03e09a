import os
import tempfile

import pytest

from pyspark.sql import functions as F

from churnlab import schemas
from churnlab.plans import flows
from churnlab.sources import fixtures as fx
from churnlab.sources import readers
from conftest import SF001


def test_csv_scan_with_schema(spark):
    d = tempfile.mkdtemp(prefix="churnlab-csv-")
    path = os.path.join(d, "churn.csv")
    with open(path, "w") as f:
        f.write("more,churn,id\nx,1,abc\ny,0,def\nz,,ghi\n")
    df = readers.read_churn(spark, path)
    assert df.schema == schemas.CHURN_SCHEMA
    assert sorted((r["id"], r["churn"]) for r in df.collect()) == [("abc", 1), ("def", 0), ("ghi", None)]
    for text in ("id,churn\nabc,x\n", "id,other\nabc,1\n"):
        with open(path, "w") as f:
            f.write(text)
        with pytest.raises(Exception):
            readers.read_churn(spark, path).collect()
    p = os.path.join(d, "prices.csv")
    with open(p, "w") as f:
        f.write("id,price_date,price_p1_var,price_p2_var,price_p3_var,price_p1_fix,price_p2_fix,price_p3_fix\n"
                "abc,2015-01-01,0.1,0.2,,44.3,0,0\n")
    row = readers.read_prices(spark, p).first()
    assert row["price_p3_var"] is None and row["price_p1_fix"] == 44.3


def test_customer_matrix_and_price_features_on_fixtures(spark):
    cfg = flows.FIXTURE_CONFIG
    m = flows.customer_matrix(fx.customers(spark, SF001), fx.churn_flags(spark, SF001), cfg)
    assert "channel_nul" not in m.columns and any(c.startswith("channel_") for c in m.columns)
    assert not [c for c in cfg.date_columns if c in m.columns]
    assert m.count() == fx.churn_flags(spark, SF001).count()
    # months / tenure present and outlier columns have no NULL left (omit policy fills them)
    assert m.where(F.col("months_renewal").isNull()).count() == 0
    pf = flows.price_features(fx.prices(spark, SF001), cfg)
    assert "mean_6m_price_p1" in pf.columns and pf.count() > 0


def test_model_report_end_to_end(spark):
    cfg = flows.FIXTURE_CONFIG
    m = flows.customer_matrix(fx.customers(spark, SF001), fx.churn_flags(spark, SF001), cfg)
    h = flows.price_history(fx.prices(spark, SF001), cfg)
    table = flows.training_table(m, h)
    out = flows.model_report(table, base_params={"n_estimators": 3, "max_depth": 2},
                             grid={"max_depth": [2, 3], "learning_rate": [0.1], "n_estimators": [3]})
    assert out["cv_fold_auc"].count() == 3
    assert out["grid_candidates"].count() == 2
    assert out["holdout_report"].count() == 5
    assert out["cv_mean_roc"].count() == 100
    assert out["importance"].count() > 0
    auc = out["holdout_auc"].first()["auc"]
    assert 0.5 < auc <= 1.0


def test_customer_grain_training_table(spark):
    cfg = flows.FIXTURE_CONFIG
    m = flows.customer_matrix(fx.customers(spark, SF001), fx.churn_flags(spark, SF001), cfg)
    h = flows.price_history(fx.prices(spark, SF001), cfg)
    t = flows.training_table(m, h, grain="customer", cfg=cfg)
    assert t.count() == t.select("id").distinct().count()
    assert "mean_3m_price_p2" in t.columns
