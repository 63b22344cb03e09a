"""Registered queries: cleaning operators (CL1-CL10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlab import schemas
from churnlab.operators import clean, features
from churnlab.plans.catalog import register
from churnlab.plans.util import f32
from churnlab.sources import fixtures as fx

PM = schemas.PRICE_MEASURES
FIX = schemas.PRICE_FIX
DATES = ["date_modif_prod", "date_end", "date_renewal"]
CC_OUT = ["cons_12m", "cons_last_month", "imp_cons", "margin_net_pow_ele", "net_margin"]
PAIRS = {f"price_p{k}": (f"price_p{k}_var", f"price_p{k}_fix") for k in (1, 2, 3)}
FEATS = [f"mean_year_{c}" for c in PM] + [f"mean_year_price_p{k}" for k in (1, 2, 3)]


def _mode_sql(table, c):
    return (f"(SELECT value FROM (SELECT {c} AS value, count(*) AS cnt FROM {table} WHERE {c} IS NOT NULL "
            f"GROUP BY {c}) ORDER BY cnt DESC, value LIMIT 1) AS m_{c}")


CFG_LOG = ("cons_12m", "cons_last_month", "imp_cons")


@register("cl1_fill_dates_with_mode",
          "WITH m AS (SELECT " + ", ".join(_mode_sql("cust_churn", c) for c in DATES) + ")\n"
          "SELECT id, " + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in DATES) + " FROM cust_churn, m",
          ("cust_churn",))
def cl1_fill_dates_with_mode(spark, sf):
    return clean.fill_with_mode(fx.cust_churn(spark, sf).select("id", *DATES), DATES)


_MED = "SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in PM) + " FROM prices"
_CL2 = (f"WITH m AS ({_MED})\nSELECT id, price_date, "
        + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in PM) + " FROM prices, m")


@register("cl2_fill_prices_with_median",
          f"SELECT id, price_date, " + ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in PM) + f" FROM ({_CL2})",
          ("prices",))
def cl2_fill_prices_with_median(spark, sf):
    return f32(clean.fill_with_median(fx.stored_prices(spark, sf), PM))


@register("cl3_negative_fixed_prices_to_median",
          f"WITH f AS ({_CL2}), m AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in FIX) + " FROM f)\n"
          "SELECT id, price_date, " + ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in PM if c not in FIX) + ", "
          + ", ".join(f"CAST(CASE WHEN {c} < 0 THEN m_{c} ELSE {c} END AS FLOAT) AS {c}" for c in FIX)
          + " FROM f, m", ("prices",))
def cl3_negative_fixed_prices_to_median(spark, sf):
    """CL2 + CL3 as in the reference (the oracle takes the second median over the filled column)."""
    return f32(clean.fill_and_fix_with_median(fx.stored_prices(spark, sf), PM, FIX))


@register("cl3_negatives_to_median_two_pass",
          "WITH m AS (SELECT " + ", ".join(f"median({c}) AS m_{c}" for c in FIX) + " FROM prices)\n"
          "SELECT id, price_date, " + ", ".join(f"CAST(CASE WHEN {c} < 0 THEN m_{c} ELSE {c} END AS FLOAT) AS {c}"
                                              for c in FIX) + " FROM prices, m", ("prices",))
def cl3_negatives_to_median_two_pass(spark, sf):
    """CL3 alone, on data that was not median-filled: its own median pass."""
    p = fx.stored_prices(spark, sf).select("id", "price_date", *FIX)
    return f32(clean.negatives_to_median(p, FIX))


@register("cl4_drop_sparse_columns", """
SELECT id, channel_sales, activity_new, CAST(cons_12m AS FLOAT) AS cons_12m, date_activ, date_end, date_modif_prod,
       date_renewal, nb_prod_act, CAST(cons_last_month AS FLOAT) AS cons_last_month, CAST(imp_cons AS FLOAT) AS imp_cons,
       CAST(margin_net_pow_ele AS FLOAT) AS margin_net_pow_ele, CAST(net_margin AS FLOAT) AS net_margin, has_gas, churn
FROM cust_churn
""", ("cust_churn",))
def cl4_drop_sparse_columns(spark, sf):
    return f32(clean.drop_sparse(fx.cust_churn(spark, sf), max_missing_pct=60.0))


@register("cl5_negatives_to_null", """
SELECT id, CAST(CASE WHEN cons_12m >= 0 THEN cons_12m END AS FLOAT) AS cons_12m,
       CAST(CASE WHEN cons_last_month >= 0 THEN cons_last_month END AS FLOAT) AS cons_last_month,
       CAST(CASE WHEN imp_cons >= 0 THEN imp_cons END AS FLOAT) AS imp_cons FROM cust_churn
""", ("cust_churn",))
def cl5_negatives_to_null(spark, sf):
    cols = list(CFG_LOG)
    return f32(clean.negatives_to_null(fx.cust_churn(spark, sf).select("id", *cols), cols))


def _zrep_sql(table, key, cols, z=3):
    s1 = ", ".join(f"avg({c}) AS mu1_{i}, stddev_pop({c}) AS sd1_{i}" for i, c in enumerate(cols))
    s2 = ", ".join(f"avg(CASE WHEN abs(({c} - mu1_{i}) / sd1_{i}) < {z} THEN {c} END) AS m_{i}"
                   for i, c in enumerate(cols))
    fill = ", ".join(f"coalesce({c}, m_{i}) AS {c}" for i, c in enumerate(cols))
    s3 = ", ".join(f"avg({c}) AS mu2_{i}, stddev_pop({c}) AS sd2_{i}" for i, c in enumerate(cols))
    out = ", ".join(f"CAST(CASE WHEN abs(({c} - mu2_{i}) / sd2_{i}) > {z} THEN m_{i} ELSE {c} END AS FLOAT) AS {c}"
                    for i, c in enumerate(cols))
    rep = "\nUNION ALL\n".join(
        f"(SELECT '{c}' AS \"column\", (SELECT count(*) FROM {table} WHERE {c} IS NULL) AS n_null, "
        f"count(*) FILTER (WHERE abs(({c} - mu2_{i}) / sd2_{i}) > {z}) AS n_outlier, "
        f"CAST(any_value(m_{i}) AS FLOAT) AS inlier_mean FROM f, s2, s3)" for i, c in enumerate(cols))
    head = (f"WITH s1 AS (SELECT {s1} FROM {table}),\ns2 AS (SELECT {s2} FROM {table}, s1),\n"
            f"f AS (SELECT {key}, {fill} FROM {table}, s2),\ns3 AS (SELECT {s3} FROM f)\n")
    return head + f"SELECT {key}, {out} FROM f, s2, s3", head + rep


_CL7, _CL7_REP = _zrep_sql("cust_churn", "id", CC_OUT)


@register("cl7_replace_outliers_zscore", _CL7, ("cust_churn",))
def cl7_replace_outliers_zscore(spark, sf):
    out, _ = clean.replace_outliers_zscore(fx.cust_churn(spark, sf).select("id", *CC_OUT), CC_OUT, report=False)
    return f32(out)


@register("cl7_outlier_report", _CL7_REP, ("cust_churn",))
def cl7_outlier_report(spark, sf):
    _, rep = clean.replace_outliers_zscore(fx.cust_churn(spark, sf).select("id", *CC_OUT), CC_OUT)
    return f32(rep)


@register("cl7_replace_outliers_propagate", """
WITH s1 AS (SELECT avg(imp_cons) AS mu1, stddev_pop(imp_cons) AS sd1 FROM cust_churn),
s2 AS (SELECT avg(CASE WHEN abs((imp_cons - mu1) / sd1) < 3 THEN imp_cons END) AS m FROM cust_churn, s1),
s3 AS (SELECT avg(coalesce(imp_cons, m)) AS mu2, stddev_pop(coalesce(imp_cons, m)) AS sd2 FROM cust_churn, s2)
SELECT id, CAST(cons_last_month AS FLOAT) AS cons_last_month,
       CAST(CASE WHEN abs((imp_cons - mu2) / sd2) > 3 THEN m ELSE imp_cons END AS FLOAT) AS imp_cons
FROM cust_churn, s2, s3
""", ("cust_churn",))
def cl7_replace_outliers_propagate(spark, sf):
    """'propagate': cons_last_month has NULLs, so it stays untouched; imp_cons has none and is cleaned."""
    df = fx.cust_churn(spark, sf).select("id", "cons_last_month", "imp_cons")
    out, _ = clean.replace_outliers_zscore(df, ["cons_last_month", "imp_cons"], null_policy="propagate",
                                           report=False)
    return f32(out)


_FE1_YEAR = ("SELECT id, " + ", ".join(f"avg({c}) AS mean_year_{c}" for c in PM) + " FROM prices GROUP BY id")
_FE1_YEAR_P = ("SELECT *, " + ", ".join(f"mean_year_price_p{k}_var + mean_year_price_p{k}_fix AS mean_year_price_p{k}"
                                         for k in (1, 2, 3)) + f" FROM ({_FE1_YEAR})")
_CL6, _ = _zrep_sql("feats", "id", FEATS)


@register("cl6_replace_outliers_price_features", f"WITH feats AS ({_FE1_YEAR_P}),\n" + _CL6[5:], ("prices",))
def cl6_replace_outliers_price_features(spark, sf):
    feats = features.price_window_means(fx.prices(spark, sf), PM, windows={"year": None}, pairs=PAIRS)
    out, _ = clean.replace_outliers_zscore(feats, [c for c in feats.columns if c != "id"], report=False)
    return f32(out)


@register("cl8_iqr_fences_event_value", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT CAST(q3 - q1 AS FLOAT) AS iqr, CAST(q1 - 1.5 * (q3 - q1) AS FLOAT) AS lower_bound,
       CAST(q3 + 1.5 * (q3 - q1) AS FLOAT) AS upper_bound FROM q
""")
def cl8_iqr_fences_event_value(spark, sf):
    return f32(clean.iqr_fences(fx.table(spark, sf, "events"), "value"))


@register("cl9_remove_outliers_iqr", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value FROM events, q WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)
""")
def cl9_remove_outliers_iqr(spark, sf):
    return clean.remove_outliers_iqr(fx.table(spark, sf, "events").select("event_id", "value"), "value")


@register("cl10_remove_outliers_zscore", """
WITH s AS (SELECT avg(price_p1_var) AS mu, stddev_pop(price_p1_var) AS sd FROM prices)
SELECT id, price_date, price_p1_var FROM prices, s WHERE abs((price_p1_var - mu) / sd) < 3
""", ("prices",))
def cl10_remove_outliers_zscore(spark, sf):
    p = fx.prices(spark, sf).select("id", "price_date", "price_p1_var")
    return clean.remove_outliers_zscore(p, "price_p1_var")
