"""Registered queries: scalar and date functions (SF1-SF14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlab.functions import dates as D
from churnlab.functions import scalar as S
from churnlab.operators import rates
from churnlab.plans.catalog import register
from churnlab.plans.util import f32
from churnlab.sources import fixtures as fx


@register("sf1_parse_dates", """
SELECT id, TRY_CAST(date_activ AS DATE) AS date_activ, TRY_CAST(date_end AS DATE) AS date_end,
       TRY_CAST(date_modif_prod AS DATE) AS date_modif_prod, TRY_CAST(date_renewal AS DATE) AS date_renewal
FROM customers
""", ("customers",))
def sf1_parse_dates(spark, sf):
    c = fx.customers(spark, sf)
    cols = ["date_activ", "date_end", "date_modif_prod", "date_renewal"]
    return c.select("id", *[D.parse_date(x).alias(x) for x in cols])


@register("sf2_whole_years_activ_to_renewal", """
SELECT id, CAST(trunc(date_diff('day', CAST(date_activ AS DATE), CAST(date_renewal AS DATE)) / 365.2425) AS INTEGER) AS years
FROM customers
""", ("customers",))
def sf2_whole_years_activ_to_renewal(spark, sf):
    c = fx.customers(spark, sf)
    return c.select("id", D.whole_years(D.parse_date("date_renewal"), D.parse_date("date_activ")).alias("years"))


@register("sf3_whole_months_to_reference", """
SELECT id, CAST(trunc(date_diff('day', CAST(date_modif_prod AS DATE), DATE '2001-06-15') / 30.436875) AS INTEGER) AS months
FROM customers
""", ("customers",))
def sf3_whole_months_to_reference(spark, sf):
    c = fx.customers(spark, sf)
    return c.select("id", D.whole_months(F.to_date(F.lit("2001-06-15")), D.parse_date("date_modif_prod")).alias("months"))


@register("sf4_month_tick_labels", """
SELECT DISTINCT last_day(CAST(price_date AS DATE)) AS month_end,
       substr(strftime(last_day(CAST(price_date AS DATE)), '%B'), 1, 1) ||
       CASE WHEN month(CAST(price_date AS DATE)) = 1 THEN chr(10) || CAST(year(CAST(price_date AS DATE)) AS VARCHAR) ELSE '' END AS label
FROM prices
""", ("prices",))
def sf4_month_tick_labels(spark, sf):
    m = fx.prices(spark, sf).select(F.last_day(D.parse_date("price_date")).alias("month_end")).distinct()
    return m.select("month_end", D.month_tick_label("month_end").alias("label"))


@register("sf5_log10p1_event_value", """
SELECT event_id, CAST(CASE WHEN value + 1.0 > 0 THEN log10(value + 1.0) END AS FLOAT) AS log_value FROM events
""")
def sf5_log10p1_event_value(spark, sf):
    return f32(fx.table(spark, sf, "events").select("event_id", S.log10p1("value").alias("log_value")))


@register("sf6_map_flag", """
SELECT id, CASE WHEN has_gas = 't' THEN 1 WHEN has_gas = 'f' THEN 0 END AS has_gas FROM customers
""", ("customers",))
def sf6_map_flag(spark, sf):
    return fx.customers(spark, sf).select("id", S.map_values("has_gas", {"t": 1, "f": 0}).alias("has_gas"))


@register("sf7_replace_values", """
SELECT id, CASE WHEN channel_sales IN ('AUTOMOBILE', 'BUILDING') THEN 'other' ELSE channel_sales END AS channel_sales
FROM customers
""", ("customers",))
def sf7_replace_values(spark, sf):
    c = fx.customers(spark, sf)
    return c.select("id", S.replace_values("channel_sales", ["AUTOMOBILE", "BUILDING"], "other").alias("channel_sales"))


@register("sf8_fill_constants", """
SELECT id, coalesce(channel_sales, 'null_channels') AS channel_sales,
       CAST(coalesce(cons_last_month, 0) AS FLOAT) AS cons_last_month FROM customers
""", ("customers",))
def sf8_fill_constants(spark, sf):
    c = fx.customers(spark, sf)
    return f32(c.select("id", S.fill("channel_sales", "null_channels").alias("channel_sales"),
                        S.fill("cons_last_month", 0.0).alias("cons_last_month")))


@register("sf9_negate_months", """
SELECT id, -CAST(trunc(date_diff('day', CAST(date_end AS DATE), DATE '2016-01-01') / 30.436875) AS INTEGER) AS months_end
FROM customers
""", ("customers",))
def sf9_negate_months(spark, sf):
    c = fx.customers(spark, sf)
    return c.select("id", S.negate(D.whole_months(F.to_date(F.lit("2016-01-01")), D.parse_date("date_end")))
                    .alias("months_end"))


@register("sf10_round_half_even", """
SELECT id, round_even(net_margin / 1000.0, 0) AS k0, round_even(imp_cons / 1000.0, 1) AS k1 FROM customers
""", ("customers",))
def sf10_round_half_even(spark, sf):
    c = fx.customers(spark, sf)
    return c.select("id", S.round_half_even(F.col("net_margin") / 1000.0, 0).alias("k0"),
                    S.round_half_even(F.col("imp_cons") / 1000.0, 1).alias("k1"))


@register("sf11_zscore_event_value", """
WITH s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM events)
SELECT event_id, CAST((value - mu) / sd AS FLOAT) AS z FROM events, s
""")
def sf11_zscore_event_value(spark, sf):
    return f32(S.zscore_frame(fx.table(spark, sf, "events").select("event_id", "value"), "value", "z")
               .select("event_id", "z"))


@register("sf12_clamp_zscore", """
WITH s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM events)
SELECT event_id, CAST(least(greatest((value - mu) / sd, 0.0), 1.0) AS FLOAT) AS z01 FROM events, s
""")
def sf12_clamp_zscore(spark, sf):
    z = S.zscore_frame(fx.table(spark, sf, "events").select("event_id", "value"), "value", "z")
    return f32(z.select("event_id", S.clamp("z").alias("z01")))


_CELLS = ", ".join(f"CASE WHEN count(*) FILTER (WHERE churn = {v}) > 0 THEN count(id) FILTER (WHERE churn = {v}) END "
                   f"AS class_{v}" for v in (0, 1))
_T = "(coalesce(class_0, 0) + coalesce(class_1, 0))"


@register("sf14_bar_labels", f"""
WITH ct AS (SELECT nb_prod_act, {_CELLS} FROM cust_churn WHERE nb_prod_act IS NOT NULL GROUP BY nb_prod_act),
p AS (SELECT nb_prod_act, class_0 / {_T} * 100 AS pct_0, class_1 / {_T} * 100 AS pct_1 FROM ct)
SELECT nb_prod_act,
       CASE WHEN printf('%.1f', round_even(pct_0, 1)) <> '0.0' THEN printf('%.1f', round_even(pct_0, 1)) END AS label_0,
       CASE WHEN printf('%.1f', round_even(pct_1, 1)) <> '0.0' THEN printf('%.1f', round_even(pct_1, 1)) END AS label_1
FROM p
""", ("cust_churn",))
def sf14_bar_labels(spark, sf):
    p = rates.row_percent(rates.crosstab(fx.cust_churn(spark, sf), "nb_prod_act"))
    return p.select("nb_prod_act", S.bar_label("pct_0").alias("label_0"), S.bar_label("pct_1").alias("label_1"))
