"""Registered queries: chart tables (CH1-CH5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlab import schemas
from churnlab.operators import charts, features
from churnlab.plans.catalog import register
from churnlab.plans.util import f32
from churnlab.sources import fixtures as fx

PM = schemas.PRICE_MEASURES


@register("ch1_histogram_cons_by_churn", """
WITH v AS (SELECT cons_12m AS x, churn FROM cust_churn WHERE cons_12m IS NOT NULL),
b0 AS (SELECT min(x) AS mn, max(x) AS mx FROM v),
b AS (SELECT CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM b0),
b2 AS (SELECT lo, hi, (hi - lo) / 50 AS step FROM b),
j AS (SELECT x, churn, lo, hi, step, CAST(least(greatest(floor((x - lo) / (hi - lo) * 50), 0), 49) AS INTEGER) AS i0
      FROM v, b2),
k AS (SELECT churn,
             i0 - CASE WHEN x < (CASE WHEN i0 >= 50 THEN hi ELSE lo + i0 * step END) THEN 1 ELSE 0 END
                + CASE WHEN x >= (CASE WHEN i0 + 1 >= 50 THEN hi ELSE lo + (i0 + 1) * step END) AND i0 <> 49
                       THEN 1 ELSE 0 END AS bin FROM j),
c AS (SELECT bin, count(*) FILTER (WHERE churn = 0) AS class_0, count(*) FILTER (WHERE churn = 1) AS class_1
      FROM k GROUP BY bin),
s AS (SELECT CAST(r.range AS INTEGER) AS bin, CASE WHEN r.range >= 50 THEN hi ELSE lo + r.range * step END AS bin_start,
             CASE WHEN r.range + 1 >= 50 THEN hi ELSE lo + (r.range + 1) * step END AS bin_end FROM b2, range(50) r)
SELECT s.bin, CAST(bin_start AS FLOAT) AS bin_start, CAST(bin_end AS FLOAT) AS bin_end,
       coalesce(class_0, 0) AS class_0, coalesce(class_1, 0) AS class_1
FROM s LEFT JOIN c ON s.bin = c.bin
""", ("cust_churn",))
def ch1_histogram_cons_by_churn(spark, sf):
    return f32(charts.histogram_by_class(fx.cust_churn(spark, sf), "cons_12m"))


@register("ch2_box_stats_event_value", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                  quantile_cont(value, 0.75) AS q3 FROM events),
q2 AS (SELECT q1, median, q3, q3 - q1 AS iqr FROM q)
SELECT CAST(q1 AS FLOAT) AS q1, CAST(median AS FLOAT) AS median, CAST(q3 AS FLOAT) AS q3, CAST(iqr AS FLOAT) AS iqr,
       count(value) AS n,
       CAST(min(CASE WHEN value >= q1 - 1.5 * iqr THEN value END) AS FLOAT) AS whisker_low,
       CAST(max(CASE WHEN value <= q3 + 1.5 * iqr THEN value END) AS FLOAT) AS whisker_high,
       count(*) FILTER (WHERE value < q1 - 1.5 * iqr OR value > q3 + 1.5 * iqr) AS n_outliers
FROM events, q2 WHERE value IS NOT NULL GROUP BY q1, median, q3, iqr
""")
def ch2_box_stats_event_value(spark, sf):
    return f32(charts.box_stats(fx.table(spark, sf, "events"), "value"))


@register("ch3_density_event_value", """
WITH v AS (SELECT value AS x FROM events WHERE value IS NOT NULL),
s0 AS (SELECT count(x) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM v),
s1 AS (SELECT *, sd * pow(n, -0.2) AS bw FROM s0),
s2 AS (SELECT *, mn - 3.0 * bw AS glo, mx + 3.0 * bw AS ghi FROM s1),
s AS (SELECT *, (ghi - glo) / 99 AS gstep FROM s2),
c AS (SELECT CAST(k AS INTEGER) AS k, sum(exp(-0.5 * ((glo + k * gstep - x) / bw) * ((glo + k * gstep - x) / bw))) AS ksum
      FROM v, s, range(100) AS g(k) WHERE bw > 0 GROUP BY 1),
sp AS (SELECT CAST(range AS INTEGER) AS k FROM range(100))
SELECT sp.k, CAST(glo + sp.k * gstep AS FLOAT) AS x,
       CAST(coalesce(ksum, 0.0) * (1.0 / sqrt(2.0 * pi())) / (n * bw) AS FLOAT) AS density
FROM sp LEFT JOIN c ON sp.k = c.k CROSS JOIN s
""")
def ch3_density_event_value(spark, sf):
    return f32(charts.density(fx.table(spark, sf, "events"), "value"))


_BOUND = 300


@register("ch3_density_binned", f"""
WITH v AS (SELECT value AS x FROM events WHERE value IS NOT NULL),
s0 AS (SELECT count(x) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM v),
s1 AS (SELECT *, sd * pow(n, -0.2) AS bw, (mx - mn) / {_BOUND} AS d FROM s0),
s AS (SELECT *, mn - 3.0 * bw AS glo, (mx - mn + 6.0 * bw) / 99 AS gstep FROM s1),
p AS (SELECT least(floor((x - mn) / d), {_BOUND - 1}) AS low, (x - mn) / d AS place FROM v, s),
w AS (SELECT j, sum(w) AS w FROM (SELECT low AS j, 1 - (place - low) AS w FROM p UNION ALL SELECT low + 1, place - low FROM p) GROUP BY j),
k AS (SELECT CAST(range AS INTEGER) AS k FROM range(100)),
b AS (SELECT k, sum(w * exp(-0.5 * ((glo + k * gstep - mn - j * d) / bw) ** 2)) / any_value(n * bw * sqrt(2 * pi())) AS density FROM w, s, k GROUP BY k),
e AS (SELECT k, sum(exp(-0.5 * ((glo + k * gstep - x) / bw) ** 2)) / any_value(n * bw * sqrt(2 * pi())) AS exact FROM v, s, k GROUP BY k)
SELECT k, CAST(glo + k * gstep AS FLOAT) AS x, CAST(density AS FLOAT) AS density, CAST(d * d / (8 * sqrt(2 * pi()) * bw ** 3) AS FLOAT) AS error,
       abs(density - exact) <= d * d / (8 * sqrt(2 * pi()) * bw ** 3) AS within
FROM b JOIN e USING (k), s
""")
def ch3_density_binned(spark, sf):
    """The binned density with its bound, and whether the exact density lies inside."""
    ev = fx.table(spark, sf, "events")
    exact = charts.density(ev, "value").select("k", F.col("density").alias("exact"))
    both = charts.density_binned(ev, "value", bins=_BOUND).join(exact, "k")
    return f32(both.withColumn("within", F.abs(F.col("density") - F.col("exact")) <= F.col("error")).drop("exact"))


_CELLS = ", ".join(f"CASE WHEN count(*) FILTER (WHERE churn = {v}) > 0 THEN count(id) FILTER (WHERE churn = {v}) END "
                   f"AS class_{v}" for v in (0, 1))


@register("ch4_stacked_bars_tenure", f"""
WITH t AS (SELECT id, churn, CAST(trunc(date_diff('day', CAST(date_activ AS DATE), CAST(date_end AS DATE)) / 365.2425)
                  AS INTEGER) AS tenure FROM cust_churn),
ct AS (SELECT tenure, {_CELLS} FROM t WHERE tenure IS NOT NULL GROUP BY tenure),
l AS (SELECT tenure, 0 AS class, CAST(class_0 AS DOUBLE) AS height FROM ct
      UNION ALL SELECT tenure, 1 AS class, CAST(class_1 AS DOUBLE) AS height FROM ct)
SELECT tenure, class, height,
       CASE WHEN height IS NOT NULL AND printf('%.1f', round_even(height, 1)) <> '0.0'
            THEN printf('%.1f', round_even(height, 1)) END AS label FROM l
""", ("cust_churn",))
def ch4_stacked_bars_tenure(spark, sf):
    t = features.tenure(fx.cust_churn(spark, sf))
    return charts.stacked_bar_table(t, "tenure", percent=False)


_FEATS = [f"mean_year_{c}" for c in PM]
_FE1 = "SELECT id, " + ", ".join(f"avg({c}) AS mean_year_{c}" for c in PM) + " FROM prices GROUP BY id"


@register("ch5_heatmap_price_features", f"WITH feats AS ({_FE1})\n" + "\nUNION ALL\n".join(
    f"(SELECT '{a}' AS a, '{b}' AS b, CAST(corr({a}, {b}) AS FLOAT) AS r FROM feats)"
    for a in _FEATS for b in _FEATS), ("prices",))
def ch5_heatmap_price_features(spark, sf):
    feats = features.price_window_means(fx.prices(spark, sf), PM, windows={"year": None})
    return f32(charts.heatmap_cells(feats, _FEATS).drop("text"))


@register("ch5_heatmap_annotations", f"WITH feats AS ({_FE1}), cells AS (" + "\nUNION ALL\n".join(
    f"(SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM feats)" for a in _FEATS for b in _FEATS)
    + ") SELECT a, b, CAST(r AS FLOAT) AS r, printf('%.2f', r) AS text FROM cells", ("prices",))
def ch5_heatmap_annotations(spark, sf):
    feats = features.price_window_means(fx.prices(spark, sf), PM, windows={"year": None})
    return f32(charts.heatmap_cells(feats, _FEATS))
