"""Registered queries: scans, profiling, projections, filters (SC*, IN*, PR*, FI*, AG9/10/13)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlab import schemas
from churnlab.operators import filters, profile, project, rates, sketches
from churnlab.plans.catalog import register
from churnlab.plans.util import f32, rnd
from churnlab.session import materialize
from churnlab.sources import fixtures as fx
from churnlab.sources import readers

PM = schemas.PRICE_MEASURES
CC_COLS = [("id", "bigint"), ("channel_sales", "string"), ("activity_new", "string"),
           ("campaign_disc_ele", "string"), ("cons_12m", "double"), ("date_activ", "string"),
           ("date_end", "string"), ("date_modif_prod", "string"), ("date_renewal", "string"),
           ("nb_prod_act", "int"), ("cons_last_month", "double"), ("imp_cons", "double"),
           ("margin_net_pow_ele", "double"), ("net_margin", "double"), ("has_gas", "string"),
           ("churn", "int")]
CC_NUM = ["cons_12m", "nb_prod_act", "cons_last_month", "imp_cons", "margin_net_pow_ele", "net_margin"]
CUSTOMER_SCHEMA = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_nationkey", T.IntegerType()),
                                T.StructField("c_acctbal", T.DoubleType()), T.StructField("c_mktsegment", T.StringType())])


def _union(parts):
    return "\nUNION ALL\n".join(f"({p})" for p in parts)


@register("sc1_scan_customer_schema", """
SELECT c_custkey, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer
""")
def sc1_scan_customer_schema(spark, sf):
    return rnd(readers.read_parquet(spark, os.path.join(sf, "customer.parquet"), CUSTOMER_SCHEMA))


@register("in1_head10_customers", """
SELECT id, channel_sales, round(cons_12m, 6) AS cons_12m, churn FROM cust_churn ORDER BY id LIMIT 10
""", ("cust_churn",))
def in1_head10_customers(spark, sf):
    return rnd(profile.head(fx.cust_churn(spark, sf).select("id", "channel_sales", "cons_12m", "churn"), 10))


@register("in2_row_count_prices", "SELECT count(*) AS n_rows FROM prices", ("prices",))
def in2_row_count_prices(spark, sf):
    return profile.row_count(fx.prices(spark, sf))


@register("in3_info_cust_churn", _union(
    f"SELECT {i} AS position, '{c}' AS \"column\", count({c}) AS non_null, '{t}' AS dtype FROM cust_churn"
    for i, (c, t) in enumerate(CC_COLS)), ("cust_churn",))
def in3_info_cust_churn(spark, sf):
    return profile.info(fx.cust_churn(spark, sf))


@register("in5_describe_prices", _union(
    f"SELECT {i} AS position, '{c}' AS \"column\", count({c}) AS count, CAST(avg({c}) AS FLOAT) AS mean, "
    f"CAST(stddev_samp({c}) AS FLOAT) AS std, CAST(min({c}) AS FLOAT) AS min, "
    f"CAST(quantile_cont({c}, 0.25) AS FLOAT) AS p25, CAST(quantile_cont({c}, 0.5) AS FLOAT) AS p50, "
    f"CAST(quantile_cont({c}, 0.75) AS FLOAT) AS p75, CAST(max({c}) AS FLOAT) AS max FROM prices"
    for i, c in enumerate(PM)), ("prices",))
def in5_describe_prices(spark, sf):
    return f32(profile.describe(fx.stored_prices(spark, sf), PM))


@register("in5_describe_cust_churn", _union(
    f"SELECT {i} AS position, '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, "
    f"round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, "
    f"round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM cust_churn"
    for i, c in enumerate(CC_NUM)), ("cust_churn",))
def in5_describe_cust_churn(spark, sf):
    return rnd(profile.describe(fx.cust_churn(spark, sf), CC_NUM))


@register("in6_missing_pct_cust_churn", _union(
    f"SELECT {i} AS position, '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 6) "
    f"AS pct_missing FROM cust_churn" for i, (c, _) in enumerate(CC_COLS)), ("cust_churn",))
def in6_missing_pct_cust_churn(spark, sf):
    return rnd(profile.missing_pct(fx.cust_churn(spark, sf)))


@register("in6_missing_pct_prices", _union(
    f"SELECT {i} AS position, '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100, 6) "
    f"AS pct_missing FROM prices" for i, c in enumerate(["id", "price_date"] + PM)), ("prices",))
def in6_missing_pct_prices(spark, sf):
    return rnd(profile.missing_pct(fx.prices(spark, sf)))


@register("in7_missing_pct_rounded_renewal", """
SELECT round_even(avg(CASE WHEN date_renewal IS NULL THEN 1.0 ELSE 0.0 END) * 100, 0) AS pct_missing FROM customers
""", ("customers",))
def in7_missing_pct_rounded_renewal(spark, sf):
    return profile.missing_pct_rounded(fx.customers(spark, sf), "date_renewal")


@register("in8_frequencies_channel", """
SELECT channel_sales AS value, count(*) AS count FROM cust_churn WHERE channel_sales IS NOT NULL
GROUP BY channel_sales ORDER BY count DESC, value
""", ("cust_churn",))
def in8_frequencies_channel(spark, sf):
    return profile.frequencies(fx.cust_churn(spark, sf), "channel_sales")


def _corr_sql(table, cols):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {table}")
    return _union(parts)


@register("in9_correlation_cust_churn", _corr_sql("cust_churn", CC_NUM + ["churn"]), ("cust_churn",))
def in9_correlation_cust_churn(spark, sf):
    return rnd(profile.correlation(fx.cust_churn(spark, sf), CC_NUM + ["churn"]))


_ALL = ["id", "price_date", *PM]


@register("in10_duplicated_price_rows", f"""
WITH planted AS (SELECT * FROM prices UNION ALL SELECT * FROM prices WHERE id % 7 = 3
                 UNION ALL SELECT * FROM prices WHERE id % 14 = 3)
SELECT {", ".join(_ALL)} FROM (
  SELECT {", ".join(_ALL)}, unnest(generate_series(2, c)) AS k
  FROM (SELECT {", ".join(_ALL)}, count(*) AS c FROM planted GROUP BY ALL HAVING count(*) > 1))
""", ("prices",))
def in10_duplicated_price_rows(spark, sf):
    """Whole-row duplicates of the price history, with copies of some customers' rows planted."""
    p = fx.prices(spark, sf)
    planted = p.unionByName(p.where("id % 7 = 3")).unionByName(p.where("id % 14 = 3"))
    # read twice, for the hashes and for the rows
    return profile.duplicated_rows(materialize(planted.select(*_ALL), "planted"))


@register("ag9_median_prices",
          "SELECT " + ", ".join(f"round(median({c}), 6) AS {c}" for c in PM) + " FROM prices", ("prices",))
def ag9_median_prices(spark, sf):
    return rnd(profile.medians(fx.stored_prices(spark, sf), PM))


_DATES = ["date_modif_prod", "date_end", "date_renewal"]


@register("ag10_mode_dates", _union(
    f"SELECT '{c}' AS \"column\", value AS mode, cnt FROM (SELECT {c} AS value, count(*) AS cnt FROM cust_churn "
    f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY cnt DESC, value LIMIT 1)" for c in _DATES), ("cust_churn",))
def ag10_mode_dates(spark, sf):
    return profile.modes(fx.cust_churn(spark, sf), _DATES)


_WIDE = ("WITH wide AS (SELECT l_orderkey * 10 + l_linenumber AS part, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, "
         "CASE WHEN l_orderkey % 10 < 3 THEN l_orderkey % 2 WHEN l_linenumber < 6 THEN l_orderkey * 10 + l_linenumber END AS often FROM lineitem) ")


@register("ag10_mode_wide_domains", _WIDE + _union(
    f"SELECT '{c}' AS \"column\", value AS mode, cnt FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM wide "
    f"WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY cnt DESC, value LIMIT 1)" for c in ("price", "often", "part")))
def ag10_mode_wide_domains(spark, sf):
    """Modes of columns with about as many values as rows: one with two leaders that tie or nearly do, two without any."""
    li = fx.table(spark, sf, "lineitem")
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    wide = li.select((key * 10 + line).alias("part"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("price"),
                     F.when(key % 10 < 3, key % 2).when(line < 6, key * 10 + line).alias("often"))
    return profile.modes(wide, ["price", "often", "part"])


_SKETCHED = ["price_p1_var", "price_p2_var", "price_p1_fix"]


@register("in5_sketches_by_month", _union(
    f"SELECT substr(price_date, 1, 7) AS part, '{c}' AS \"column\", count({c}) AS n FROM prices GROUP BY ALL HAVING count({c}) > 0"
    for c in _SKETCHED), ("prices",))
def in5_sketches_by_month(spark, sf):
    """Values in every stored sketch, one per month and price column."""
    s = sketches.build(fx.prices(spark, sf), _SKETCHED, F.substring("price_date", 1, 7))
    return s.select("part", "column", F.kll_sketch_get_n_double("sketch").alias("n"))


@register("ag13_quartiles_from_sketches", _union(
    f"SELECT '{c}' AS \"column\", count({c}) AS n, TRUE AS q25, TRUE AS q50, TRUE AS q75 FROM prices" for c in _SKETCHED), ("prices",))
def ag13_quartiles_from_sketches(spark, sf):
    """Quartiles of merged monthly sketches; true where the quantile's exact rank is within the stated error."""
    p = fx.prices(spark, sf)
    stored = materialize(sketches.build(p, _SKETCHED, F.substring("price_date", 1, 7)), "sketches")
    found = {r["column"]: r for r in sketches.describe(stored).collect()}
    e, probs = sketches.rank_error(), (0.25, 0.5, 0.75)
    rows = []
    ranks = p.agg(*[x.alias(f"{c}_{i}_{side}") for c in _SKETCHED for i, nm in enumerate(("p25", "p50", "p75"))
                    for side, x in (("below", F.count_if(F.col(c) < found[c][nm])), ("upto", F.count_if(F.col(c) <= found[c][nm])))]).first()
    for c in _SKETCHED:
        n = found[c]["n"]
        rows.append((c, n, *(ranks[f"{c}_{i}_below"] <= (q + e) * n and ranks[f"{c}_{i}_upto"] >= (q - e) * n for i, q in enumerate(probs))))
    return spark.createDataFrame(rows, "column string, n bigint, q25 boolean, q50 boolean, q75 boolean")


@register("ag13_quartiles_cons_12m", """
SELECT 'cons_12m' AS "column", round(quantile_cont(cons_12m, 0.25), 6) AS q25,
       round(quantile_cont(cons_12m, 0.75), 6) AS q75 FROM cust_churn
""", ("cust_churn",))
def ag13_quartiles_cons_12m(spark, sf):
    return rnd(profile.quartiles(fx.cust_churn(spark, sf), "cons_12m"))


# --- projections ----------------------------------------------------------

@register("pr1_subset_consumption", """
SELECT id, round(cons_12m, 6) AS cons_12m, round(cons_last_month, 6) AS cons_last_month,
       round(imp_cons, 6) AS imp_cons, has_gas, churn FROM cust_churn
""", ("cust_churn",))
def pr1_subset_consumption(spark, sf):
    return rnd(project.subset(fx.cust_churn(spark, sf),
                              ["id", "cons_12m", "cons_last_month", "imp_cons", "has_gas", "churn"]))


@register("pr2_rename_companies", 'SELECT id AS "Companies", churn FROM cust_churn', ("cust_churn",))
def pr2_rename_companies(spark, sf):
    return project.rename(fx.cust_churn(spark, sf).select("id", "churn"), {"id": "Companies"})


@register("pr3_drop_columns", """
SELECT id, channel_sales, activity_new, date_activ, date_end, date_modif_prod, date_renewal, nb_prod_act, has_gas, churn
FROM cust_churn
""", ("cust_churn",))
def pr3_drop_columns(spark, sf):
    return project.drop(fx.cust_churn(spark, sf), ["campaign_disc_ele", "cons_12m", "cons_last_month", "imp_cons",
                                                    "margin_net_pow_ele", "net_margin"])


@register("pr4_price_pair_sums", """
SELECT id, price_date, round(price_p1_var + price_p1_fix, 6) AS price_p1, round(price_p2_var + price_p2_fix, 6) AS price_p2,
       round(price_p3_var + price_p3_fix, 6) AS price_p3 FROM prices
""", ("prices",))
def pr4_price_pair_sums(spark, sf):
    p = project.add_pair_sums(fx.prices(spark, sf), {f"price_p{k}": (f"price_p{k}_var", f"price_p{k}_fix")
                                                     for k in (1, 2, 3)})
    return rnd(p.select("id", "price_date", "price_p1", "price_p2", "price_p3"))


@register("pr5_truncate_names", """
SELECT id, date_modif_prod AS date_modif_, date_renewal AS date_renewa, nb_prod_act,
       round(cons_last_month, 6) AS cons_last_m, round(margin_net_pow_ele, 6) AS margin_net_ FROM cust_churn
""", ("cust_churn",))
def pr5_truncate_names(spark, sf):
    df = fx.cust_churn(spark, sf).select("id", "date_modif_prod", "date_renewal", "nb_prod_act",
                                         "cons_last_month", "margin_net_pow_ele")
    return rnd(project.truncate_columns(df, 11))


@register("pr6_transpose_churn_share", """
WITH g AS (SELECT churn, count(id) AS n FROM cust_churn WHERE churn IS NOT NULL GROUP BY churn),
s AS (SELECT churn, round_even(n / (SELECT sum(n) FROM g) * 100, 1) AS pct FROM g)
SELECT 'pct' AS measure, max(CASE WHEN churn = 0 THEN pct END) AS class_0, max(CASE WHEN churn = 1 THEN pct END) AS class_1 FROM s
""", ("cust_churn",))
def pr6_transpose_churn_share(spark, sf):
    share = rates.share_pct(rates.count_by(fx.cust_churn(spark, sf), "churn"))
    return project.transpose_by_class(share, value="pct")


# --- filters --------------------------------------------------------------

@register("fi1_has_gas_t", """
SELECT id, round(cons_12m, 6) AS cons_12m, churn FROM cust_churn WHERE has_gas = 't'
""", ("cust_churn",))
def fi1_has_gas_t(spark, sf):
    return rnd(filters.equals(fx.cust_churn(spark, sf), "has_gas", "t").select("id", "cons_12m", "churn"))


@register("fi2_negative_fixed_prices", """
SELECT id, price_date, round(price_p1_fix, 6) AS price_p1_fix, round(price_p2_fix, 6) AS price_p2_fix,
       round(price_p3_fix, 6) AS price_p3_fix FROM prices
WHERE price_p1_fix < 0 OR price_p2_fix < 0 OR price_p3_fix < 0
""", ("prices",))
def fi2_negative_fixed_prices(spark, sf):
    p = fx.prices(spark, sf).select("id", "price_date", *schemas.PRICE_FIX)
    return rnd(filters.any_negative(p, schemas.PRICE_FIX))


@register("fi3_prices_after_date", """
SELECT id, price_date, round(price_p1_var, 6) AS price_p1_var FROM prices
WHERE CAST(price_date AS DATE) > DATE '2000-06-01'
""", ("prices",))
def fi3_prices_after_date(spark, sf):
    return rnd(filters.after_date(fx.prices(spark, sf), "price_date", "2000-06-01")
               .select("id", "price_date", "price_p1_var"))


@register("fi4_drop_null_renewal", """
SELECT id, date_renewal, churn FROM cust_churn WHERE date_renewal IS NOT NULL
""", ("cust_churn",))
def fi4_drop_null_renewal(spark, sf):
    return filters.drop_nulls(fx.cust_churn(spark, sf).select("id", "date_renewal", "churn"), ["date_renewal"])


_Z = """WITH s AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd FROM events)
SELECT event_id, value FROM events, s WHERE abs((value - mu) / sd) {op} 3"""


def _zscored_events(spark, sf):
    from churnlab.functions.scalar import zscore_frame
    return zscore_frame(fx.table(spark, sf, "events").select("event_id", "value"), "value", "z")


@register("fi5_inside_band_events", _Z.format(op="<"))
def fi5_inside_band_events(spark, sf):
    return filters.inside_band(_zscored_events(spark, sf), "z").select("event_id", "value")


@register("fi5_outside_band_events", _Z.format(op=">"))
def fi5_outside_band_events(spark, sf):
    return filters.outside_band(_zscored_events(spark, sf), "z").select("event_id", "value")
