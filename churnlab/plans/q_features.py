"""Registered queries: feature engineering (FE1-FE8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlab import schemas
from churnlab.operators import features, joins
from churnlab.plans.catalog import register
from churnlab.plans.util import f32
from churnlab.sources import fixtures as fx

PM = schemas.PRICE_MEASURES
PAIRS = {f"price_p{k}": (f"price_p{k}_var", f"price_p{k}_fix") for k in (1, 2, 3)}
# Stand-in window bounds inside the fixture's date range (the reference uses 2015-06-01 / 2015-10-01).
FIXTURE_WINDOWS = {"year": None, "6m": "2000-06-01", "3m": "2000-10-01"}
MONTHS = {"months_activ": "date_activ", "months_end": "date_end",
          "months_modif_prod": "date_modif_prod", "months_renewal": "date_renewal"}


def _fe1_sql():
    parts = []
    for w, b in FIXTURE_WINDOWS.items():
        for c in PM:
            v = c if b is None else f"CASE WHEN CAST(price_date AS DATE) > DATE '{b}' THEN {c} END"
            parts.append(f"avg({v}) AS mean_{w}_{c}")
    inner = "SELECT id, " + ", ".join(parts) + " FROM prices GROUP BY id"
    cols = [f"CAST(mean_{w}_{c} AS FLOAT) AS mean_{w}_{c}" for w in FIXTURE_WINDOWS for c in PM]
    cols += [f"CAST(mean_{w}_price_p{k}_var + mean_{w}_price_p{k}_fix AS FLOAT) AS mean_{w}_price_p{k}"
             for w in FIXTURE_WINDOWS for k in (1, 2, 3)]
    return "SELECT id, " + ", ".join(cols) + f" FROM ({inner})"


@register("fe1_price_window_means", _fe1_sql(), ("prices",))
def fe1_price_window_means(spark, sf):
    return f32(features.price_window_means(fx.prices(spark, sf), PM, windows=FIXTURE_WINDOWS, pairs=PAIRS))


@register("fe2_tenure_years", """
SELECT id, CAST(trunc(date_diff('day', CAST(date_activ AS DATE), CAST(date_end AS DATE)) / 365.2425) AS INTEGER) AS tenure,
       churn FROM cust_churn
""", ("cust_churn",))
def fe2_tenure_years(spark, sf):
    return features.tenure(fx.cust_churn(spark, sf)).select("id", "tenure", "churn")


@register("fe3_months_features", "SELECT id, " + ", ".join(
    f"{'-' if o == 'months_end' else ''}CAST(trunc(date_diff('day', CAST({s} AS DATE), DATE '2016-01-01') / 30.436875) "
    f"AS INTEGER) AS {o}" for o, s in MONTHS.items()) + " FROM cust_churn", ("cust_churn",))
def fe3_months_features(spark, sf):
    return features.months_features(fx.cust_churn(spark, sf), MONTHS).select("id", *MONTHS)


@register("fe4_encode_has_gas", """
SELECT id, CASE WHEN has_gas = 't' THEN 1 WHEN has_gas = 'f' THEN 0 END AS has_gas FROM cust_churn
""", ("cust_churn",))
def fe4_encode_has_gas(spark, sf):
    return features.encode_flag(fx.cust_churn(spark, sf).select("id", "has_gas"))


_CH = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("fe5_one_hot_channel", "SELECT id, " + ", ".join(
    f"CASE WHEN coalesce(channel_sales, 'null_channels') = '{v}' THEN 1 ELSE 0 END AS \"{('channel_' + v)[:11]}\""
    for v in _CH) + " FROM cust_churn", ("cust_churn",))
def fe5_one_hot_channel(spark, sf):
    """Dummies of the sales channel, names cut to 11 characters, NULL category as the dropped baseline."""
    df = fx.cust_churn(spark, sf).select("id", "channel_sales")
    return features.one_hot(df, "channel_sales", "channel", width=11, null_label="null_channels",
                            drop_label="channel_nul")


_NATIONS = [f"nation_{k}" for k in range(25)]


@register("fe5_one_hot_both", "SELECT id, " + ", ".join(
    f"CASE WHEN coalesce(channel_sales, 'null_channels') = '{v}' THEN 1 ELSE 0 END AS \"{('channel_' + v)[:11]}\""
    for v in _CH) + ", " + ", ".join(
    f"CASE WHEN activity_new = '{v}' THEN 1 ELSE 0 END AS \"activity_{v}\"" for v in _NATIONS) + " FROM cust_churn",
    ("cust_churn",))
def fe5_one_hot_both(spark, sf):
    """Both category columns of the customer table."""
    df = fx.cust_churn(spark, sf).select("id", "channel_sales", "activity_new")
    df = features.one_hot(df, "channel_sales", "channel", width=11, null_label="null_channels", drop_label="channel_nul")
    return features.one_hot(df, "activity_new", "activity", null_label="null_activity", drop_label="activity_null_activity",
                            values=_NATIONS)


@register("fe5_one_hot_many", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS INTEGER) AS position,
       CAST((SELECT count(DISTINCT c_name) FROM customer) + 1 AS INTEGER) AS size FROM customer WHERE c_name IS NOT NULL
""")
def fe5_one_hot_many(spark, sf):
    """More categories than dummy columns could hold: the position of the 1 in each row's sparse vector."""
    df = fx.table(spark, sf, "customer").where("c_name IS NOT NULL").select("c_custkey", "c_name")
    hot = features.one_hot_vector(df, "c_name", "phone")
    vector = F.unwrap_udt("phone")      # sparse: its size is a field, no row is spread out to all categories
    return hot.select("c_custkey", F.col("phone_index").cast("int").alias("position"),
                      F.coalesce(vector["size"], F.size(vector["values"])).alias("size"))


@register("fe6_fold_rare_brands", """
SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) <= 75)
                       THEN 'null_activity' ELSE p_brand END AS p_brand FROM part
""")
def fe6_fold_rare_brands(spark, sf):
    return features.fold_rare(fx.table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", 75)


@register("fe6_fold_rare_brand_counts", """
WITH f AS (SELECT CASE WHEN p_brand IN (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) <= 75)
                       THEN 'null_activity' ELSE p_brand END AS value FROM part)
SELECT value, count(*) AS count FROM f GROUP BY value
""")
def fe6_fold_rare_brand_counts(spark, sf):
    from churnlab.operators.profile import frequencies
    folded = features.fold_rare(fx.table(spark, sf, "part").select("p_brand"), "p_brand", 75)
    return frequencies(folded, "p_brand")


_LOG = ["cons_12m", "cons_last_month", "imp_cons"]


@register("fe7_log_features", "SELECT id, " + ", ".join(
    f"CAST(CASE WHEN {c} >= 0 THEN log10({c} + 1) END AS FLOAT) AS {c}" for c in _LOG) + " FROM cust_churn",
    ("cust_churn",))
def fe7_log_features(spark, sf):
    return f32(features.log_features(fx.cust_churn(spark, sf).select("id", *_LOG), _LOG))


@register("fe8_drop_correlated", """
SELECT id, channel_sales, activity_new, campaign_disc_ele, CAST(cons_12m AS FLOAT) AS cons_12m, date_activ, date_end,
       date_modif_prod, date_renewal, nb_prod_act, CAST(cons_last_month AS FLOAT) AS cons_last_month,
       CAST(imp_cons AS FLOAT) AS imp_cons, CAST(margin_net_pow_ele AS FLOAT) AS margin_net_pow_ele, has_gas, churn
FROM cust_churn
""", ("cust_churn",))
def fe8_drop_correlated(spark, sf):
    """Drops the later column of each pair with |r| > 0.8 (decided from one correlation aggregation)."""
    cc = fx.cust_churn(spark, sf)
    num = ["cons_12m", "nb_prod_act", "cons_last_month", "imp_cons", "margin_net_pow_ele", "net_margin"]
    return f32(features.drop_correlated(cc, num, threshold=0.8))


@register("jo3_same_row_columns", """
SELECT id, CAST(cons_12m - cons_last_month AS FLOAT) AS cons_gap,
       CAST(CASE WHEN net_margin > margin_net_pow_ele THEN 1 ELSE 0 END AS INTEGER) AS above FROM cust_churn
""", ("cust_churn",))
def jo3_same_row_columns(spark, sf):
    """Columns derived on the same row instead of an index-aligned merge."""
    cc = fx.cust_churn(spark, sf)
    out = joins.no_join_columns(cc, {"cons_gap": F.col("cons_12m") - F.col("cons_last_month"),
                                     "above": F.when(F.col("net_margin") > F.col("margin_net_pow_ele"), 1).otherwise(0)})
    return f32(out.select("id", "cons_gap", "above"))


_NUM = ["cons_12m", "nb_prod_act", "cons_last_month", "imp_cons", "margin_net_pow_ele", "net_margin"]


@register("fe8_correlated_pairs", "SELECT a, b, r FROM (" + " UNION ALL ".join(
    f"(SELECT '{a}' AS a, '{b}' AS b, CAST(corr({a}, {b}) AS FLOAT) AS r FROM cust_churn)"
    for i, a in enumerate(_NUM) for b in _NUM[i + 1:]) + ") WHERE abs(r) > 0.45", ("cust_churn",))
def fe8_correlated_pairs(spark, sf):
    return f32(features.correlated_pairs(fx.cust_churn(spark, sf), _NUM, 0.45))
