"""Registered queries: joins, churn rates, crosstabs, ordered reports (JO*, AG*, SO*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from churnlab.operators import joins, rates
from churnlab.plans.catalog import register
from churnlab.plans.util import rnd
from churnlab.sources import bucketed
from churnlab.sources import fixtures as fx

_CELL = ("CASE WHEN count(*) FILTER (WHERE churn = {v}) > 0 "
         "THEN count(id) FILTER (WHERE churn = {v}) END AS class_{v}")
CELLS = ", ".join(_CELL.format(v=v) for v in (0, 1))
TOTAL = "(coalesce(class_0, 0) + coalesce(class_1, 0))"


@register("jo1_join_churn", """
SELECT c.id, channel_sales, activity_new, campaign_disc_ele, round(cons_12m, 6) AS cons_12m,
       date_activ, date_end, date_modif_prod, date_renewal, nb_prod_act,
       round(cons_last_month, 6) AS cons_last_month, round(imp_cons, 6) AS imp_cons,
       round(margin_net_pow_ele, 6) AS margin_net_pow_ele, round(net_margin, 6) AS net_margin,
       has_gas, f.churn
FROM customers c JOIN churn f ON c.id = f.id
""", ("customers", "churn"))
def jo1_join_churn(spark, sf):
    return rnd(fx.cust_churn(spark, sf))


@register("jo2_join_price_history", """
SELECT c.id, c.churn, c.cons_12m, p.price_date, p.price_p1_var, p.price_p2_fix
FROM cust_churn c JOIN prices p ON c.id = p.id
""", ("cust_churn", "prices"))
def jo2_join_price_history(spark, sf):
    cc = fx.cust_churn(spark, sf).select("id", "churn", "cons_12m")
    p = fx.prices(spark, sf).select("id", "price_date", "price_p1_var", "price_p2_fix")
    return joins.join_history(cc, p)


@register("jo2_join_price_history_bucketed", """
SELECT c.id, c.churn, p.price_date, p.price_p1_var, p.price_p3_var
FROM cust_churn c JOIN prices p ON c.id = p.id
""", ("cust_churn", "prices"))
def jo2_join_price_history_bucketed(spark, sf):
    """Both sides stored in buckets of the key; the join itself shuffles nothing."""
    run = uuid.uuid4().hex
    cc = bucketed.store(fx.cust_churn(spark, sf).select("id", "churn"), f"customers_{run}", "id", 8)
    p = bucketed.store(fx.prices(spark, sf).select("id", "price_date", "price_p1_var", "price_p3_var"), f"prices_{run}", "id", 8)
    return joins.join_history(cc, p)


@register("jo2_join_price_history_salted", """
SELECT c.id, c.churn, p.price_date, p.price_p1_var, p.price_p3_var
FROM cust_churn c JOIN prices p ON c.id = p.id
""", ("cust_churn", "prices"))
def jo2_join_price_history_salted(spark, sf):
    cc = fx.cust_churn(spark, sf).select("id", "churn")
    p = fx.prices(spark, sf).select("id", "price_date", "price_p1_var", "price_p3_var")
    return joins.join_history(cc, p, salt_buckets=8)


@register("jo4_class_columns", """
SELECT id, churn, CASE WHEN churn = 0 THEN cons_12m END AS retention,
       CASE WHEN churn = 1 THEN cons_12m END AS churn_value
FROM cust_churn
""", ("cust_churn",))
def jo4_class_columns(spark, sf):
    return joins.class_columns(fx.cust_churn(spark, sf).select("id", "churn", "cons_12m"), "cons_12m")


@register("ag1_count_by_churn", """
SELECT churn, count(id) AS n FROM cust_churn WHERE churn IS NOT NULL GROUP BY churn
""", ("cust_churn",))
def ag1_count_by_churn(spark, sf):
    return rates.count_by(fx.cust_churn(spark, sf), "churn")


@register("ag2_churn_share_pct", """
WITH g AS (SELECT churn, count(id) AS n FROM cust_churn WHERE churn IS NOT NULL GROUP BY churn)
SELECT churn, n, round_even(n / (SELECT sum(n) FROM g) * 100, 1) AS pct FROM g
""", ("cust_churn",))
def ag2_churn_share_pct(spark, sf):
    return rates.share_pct(rates.count_by(fx.cust_churn(spark, sf), "churn"))


@register("ag3_crosstab_nb_orders", f"""
SELECT nb_prod_act, {CELLS} FROM cust_churn WHERE nb_prod_act IS NOT NULL GROUP BY nb_prod_act
""", ("cust_churn",))
def ag3_crosstab_nb_orders(spark, sf):
    return rates.crosstab(fx.cust_churn(spark, sf), "nb_prod_act")


@register("ag4_crosstab_channel_filled", f"""
SELECT channel_sales, coalesce(class_0, 0) AS class_0, coalesce(class_1, 0) AS class_1
FROM (SELECT channel_sales, {CELLS} FROM cust_churn WHERE channel_sales IS NOT NULL GROUP BY channel_sales)
""", ("cust_churn",))
def ag4_crosstab_channel_filled(spark, sf):
    return rates.crosstab(fx.cust_churn(spark, sf), "channel_sales", fill_zero=True)


@register("ag5_row_percent_nb_orders", f"""
SELECT nb_prod_act, class_0 / {TOTAL} * 100 AS pct_0, class_1 / {TOTAL} * 100 AS pct_1
FROM (SELECT nb_prod_act, {CELLS} FROM cust_churn WHERE nb_prod_act IS NOT NULL GROUP BY nb_prod_act)
""", ("cust_churn",))
def ag5_row_percent_nb_orders(spark, sf):
    return rates.row_percent(rates.crosstab(fx.cust_churn(spark, sf), "nb_prod_act"))


@register("so1_contract_type_pct_sorted", f"""
SELECT has_gas, class_0 / {TOTAL} * 100 AS pct_0, class_1 / {TOTAL} * 100 AS pct_1
FROM (SELECT has_gas, {CELLS} FROM cust_churn WHERE has_gas IS NOT NULL GROUP BY has_gas)
ORDER BY pct_1 DESC NULLS LAST, has_gas
""", ("cust_churn",))
def so1_contract_type_pct_sorted(spark, sf):
    ct = rates.crosstab(fx.cust_churn(spark, sf), "has_gas")
    return rates.sort_by_class(rates.row_percent(ct), "has_gas")


_RATE = ("SELECT {k}, count(id) FILTER (WHERE churn = 1) / count(id) FILTER (WHERE churn IN (0, 1)) * 100 "
         "AS churn_pct, count(id) FILTER (WHERE churn IN (0, 1)) AS n_companies "
         "FROM cust_churn WHERE {k} IS NOT NULL GROUP BY {k}")


@register("ag6_churn_rate_by_channel", _RATE.format(k="channel_sales"), ("cust_churn",))
def ag6_churn_rate_by_channel(spark, sf):
    return rates.churn_rate(fx.cust_churn(spark, sf), "channel_sales")


@register("so2_top20_activity_churn_rate",
          _RATE.format(k="activity_new") + " ORDER BY churn_pct DESC NULLS LAST, activity_new LIMIT 20",
          ("cust_churn",))
def so2_top20_activity_churn_rate(spark, sf):
    """The minimum slice: read -> JO1 -> AG6 -> SO2 (top-20 activities by churn rate)."""
    return rates.top_k(rates.churn_rate(fx.cust_churn(spark, sf), "activity_new"),
                       "churn_pct", "activity_new", 20)


@register("so2_top10_channel_churn_rate",
          _RATE.format(k="channel_sales") + " ORDER BY churn_pct DESC NULLS LAST, channel_sales LIMIT 10",
          ("cust_churn",))
def so2_top10_channel_churn_rate(spark, sf):
    return rates.top_k(rates.churn_rate(fx.cust_churn(spark, sf), "channel_sales"),
                       "churn_pct", "channel_sales", 10)


@register("ag7_monthly_crosstab_date_activ", f"""
WITH k AS (SELECT last_day(CAST(date_activ AS DATE)) AS month_end, churn, id
           FROM cust_churn WHERE date_activ IS NOT NULL),
ct AS (SELECT month_end, {CELLS} FROM k GROUP BY month_end),
spine AS (SELECT last_day(CAST(unnest(generate_series(min(date_trunc('month', month_end)),
                                                      max(date_trunc('month', month_end)),
                                                      INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM k)
SELECT s.month_end, ct.class_0, ct.class_1 FROM spine s LEFT JOIN ct ON s.month_end = ct.month_end
""", ("cust_churn",))
def ag7_monthly_crosstab_date_activ(spark, sf):
    return rates.monthly_crosstab(fx.cust_churn(spark, sf), "date_activ")


@register("ag7_monthly_crosstab_date_renewal", f"""
WITH k AS (SELECT last_day(CAST(date_renewal AS DATE)) AS month_end, churn, id
           FROM cust_churn WHERE date_renewal IS NOT NULL),
ct AS (SELECT month_end, {CELLS} FROM k GROUP BY month_end),
spine AS (SELECT last_day(CAST(unnest(generate_series(min(date_trunc('month', month_end)),
                                                      max(date_trunc('month', month_end)),
                                                      INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM k)
SELECT s.month_end, ct.class_0, ct.class_1 FROM spine s LEFT JOIN ct ON s.month_end = ct.month_end
""", ("cust_churn",))
def ag7_monthly_crosstab_date_renewal(spark, sf):
    return rates.monthly_crosstab(fx.cust_churn(spark, sf), "date_renewal")


_PM = ["price_p1_var", "price_p2_var", "price_p3_var", "price_p1_fix", "price_p2_fix", "price_p3_fix"]


@register("ag8_price_means_per_customer",
          "SELECT id, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _PM) + " FROM prices GROUP BY id",
          ("prices",))
def ag8_price_means_per_customer(spark, sf):
    return rnd(rates.group_means(fx.prices(spark, sf), "id", _PM))


@register("ag11_inlier_mean_event_value", """
WITH s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM events)
SELECT round(avg(CASE WHEN abs((value - mu) / sd) < 3 THEN value END), 6) AS value_inlier_mean FROM events, s
""")
def ag11_inlier_mean_event_value(spark, sf):
    return rnd(rates.inlier_mean(fx.table(spark, sf, "events"), "value"))


@register("ag12_null_outlier_counts", """
WITH s AS (SELECT avg(cons_last_month) AS mu, stddev_pop(cons_last_month) AS sd FROM cust_churn)
SELECT count(*) FILTER (WHERE cons_last_month IS NULL) AS n_null,
       count(*) FILTER (WHERE abs((cons_last_month - mu) / sd) > 3) AS n_outlier
FROM cust_churn, s
""", ("cust_churn",))
def ag12_null_outlier_counts(spark, sf):
    return rates.null_and_outlier_counts(fx.cust_churn(spark, sf), "cons_last_month")
