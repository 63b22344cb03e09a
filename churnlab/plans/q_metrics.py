"""Registered queries: evaluation metrics on a scored table (ML2, ML6-ML10, ML12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlab.operators import metrics, splits
from churnlab.plans.catalog import register
from churnlab.plans.util import f32
from churnlab.sources import fixtures as fx

_FOLDS = ("SELECT id, label, score, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(id AS VARCHAR)), id)"
          " - 1) % 3 AS INTEGER) AS fold FROM scored")


def _folds(spark, sf):
    return splits.stratified_folds(fx.scored(spark, sf), "label", ["id"], 3, 42, unique_keys=True)


@register("ml2_hash_split", """
SELECT id, CAST(CAST(('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % 10000 < 3300 AS INTEGER)
       AS is_test FROM scored
""", ("scored",))
def ml2_hash_split(spark, sf):
    return splits.train_test_split(fx.scored(spark, sf).select("id"), ["id"], 0.33, 42)


@register("ml2_split_sizes", """
WITH s AS (SELECT CAST(CAST(('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % 10000 < 3300 AS INTEGER)
           AS is_test FROM scored)
SELECT is_test, count(*) AS n FROM s GROUP BY is_test
""", ("scored",))
def ml2_split_sizes(spark, sf):
    return splits.train_test_split(fx.scored(spark, sf), ["id"]).groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


_ORDERED = "CAST('0x' || substr(md5('42:' || CAST(id AS VARCHAR)), 1, 15) AS BIGINT)"


@register("ml2_exact_split", f"""
SELECT id, CAST(row_number() OVER (ORDER BY {_ORDERED}, id) <= ceil(CAST(0.33 AS DOUBLE) * count(*) OVER ()) AS INTEGER) AS is_test FROM scored
""", ("scored",))
def ml2_exact_split(spark, sf):
    """Exactly ceil(0.33 n) rows, by the smallest key hashes."""
    return splits.exact_train_test_split(fx.scored(spark, sf).select("id"), ["id"])


@register("ml2_exact_split_repeated_keys", """
WITH c AS (SELECT ceil(CAST(0.33 AS DOUBLE) * count(*)) AS k, count(*) AS n FROM prices)
SELECT CAST(1 AS INTEGER) AS is_test, CAST(k AS BIGINT) AS n FROM c UNION ALL SELECT 0, CAST(n - k AS BIGINT) FROM c
""", ("prices",))
def ml2_exact_split_repeated_keys(spark, sf):
    """Price rows split by customer key: the rows of the customer at the cut are divided, the size stays exact."""
    flagged = splits.exact_train_test_split(fx.prices(spark, sf), ["id"])
    return flagged.groupBy("is_test").agg(F.count(F.lit(1)).alias("n"))


_BINNED = """
b AS (SELECT fold, CAST(least(floor(score * 50), 49) AS INTEGER) AS bin, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
      FROM folds GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps, sum(pos) OVER (PARTITION BY fold) AS p, sum(neg) OVER (PARTITION BY fold) AS n,
             row_number() OVER (PARTITION BY fold ORDER BY bin DESC) AS rank
      FROM b WINDOW w AS (PARTITION BY fold ORDER BY bin DESC ROWS UNBOUNDED PRECEDING))"""


@register("ml8_binned_roc", f"""
WITH folds AS ({_FOLDS}), {_BINNED}
SELECT fold, rank, CAST(bin * (1 / CAST(50 AS DOUBLE)) AS FLOAT) AS threshold, CAST(fps / n AS FLOAT) AS fpr, CAST(tps / p AS FLOAT) AS tpr,
       CAST(pos / p AS FLOAT) AS tpr_error FROM c
UNION ALL SELECT DISTINCT fold, 0, CAST('inf' AS FLOAT), 0, 0, 0 FROM c
""", ("scored",))
def ml8_binned_roc(spark, sf):
    return f32(metrics.binned_roc(_folds(spark, sf), group_cols=["fold"], bins=50))


@register("ml9_binned_auc_bound", f"""
WITH folds AS ({_FOLDS}), {_BINNED},
a AS (SELECT fold, sum(neg * (tps - pos / 2)) / (any_value(p) * any_value(n)) AS auc,
             sum(neg * pos) / 2 / (any_value(p) * any_value(n)) AS error FROM c GROUP BY fold),
d AS (SELECT fold, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM folds GROUP BY ALL),
e AS (SELECT fold, sum(neg * (tps - pos / 2)) / (sum(pos) * sum(neg)) AS exact
      FROM (SELECT *, sum(pos) OVER (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps FROM d) GROUP BY fold)
SELECT fold, CAST(auc AS FLOAT) AS auc, CAST(error AS FLOAT) AS error, CAST(exact AS FLOAT) AS exact, abs(auc - exact) <= error AS within
FROM a JOIN e USING (fold)
""", ("scored",))
def ml9_binned_auc_bound(spark, sf):
    """The area of binned scores with its bound, beside the exact area."""
    folded = _folds(spark, sf)
    exact = metrics.auc(folded, group_cols=["fold"], name="exact")
    both = metrics.binned_auc(folded, group_cols=["fold"], bins=50).join(exact, "fold")
    return f32(both.withColumn("within", F.abs(F.col("auc") - F.col("exact")) <= F.col("error")))


@register("ml6_accuracy_precision_recall", """
WITH c AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
                  count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
                  count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
                  count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM scored)
SELECT CAST((tp + tn) / (tp + fp + fn + tn) AS FLOAT) AS accuracy, CAST(tp / (tp + fp) AS FLOAT) AS precision,
       CAST(tp / (tp + fn) AS FLOAT) AS recall FROM c
""", ("scored",))
def ml6_accuracy_precision_recall(spark, sf):
    return f32(metrics.binary_metrics(fx.scored(spark, sf)))


def _report_sql():
    per = []
    for c in (0, 1):
        per.append(f"""count(*) FILTER (WHERE label = {c} AND prediction = {c}) / count(*) FILTER (WHERE prediction = {c})
                       AS p{c}, count(*) FILTER (WHERE label = {c} AND prediction = {c}) / count(*) FILTER (WHERE label = {c})
                       AS r{c}, count(*) FILTER (WHERE label = {c}) AS s{c}""")
    base = "SELECT count(*) AS n, count(*) FILTER (WHERE label = prediction) AS ok, " + ", ".join(per) + " FROM scored"
    f1 = "2 * p{c} * r{c} / (p{c} + r{c})"
    rows = [f"SELECT '{c}' AS row, p{c} AS precision, r{c} AS recall, {f1.format(c=c)} AS f1_score, s{c} AS support FROM b"
            for c in (0, 1)]
    rows.append("SELECT 'accuracy', NULL, NULL, ok / n, n FROM b")
    rows.append(f"SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, ({f1.format(c=0)} + {f1.format(c=1)}) / 2, n FROM b")
    rows.append(f"SELECT 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, "
                f"({f1.format(c=0)} * s0 + {f1.format(c=1)} * s1) / n, n FROM b")
    u = " UNION ALL ".join(rows)
    return (f"WITH b AS ({base}), u AS ({u})\nSELECT row, CAST(precision AS FLOAT) AS precision, "
            "CAST(recall AS FLOAT) AS recall, CAST(f1_score AS FLOAT) AS f1_score, support FROM u")


@register("ml7_classification_report", _report_sql(), ("scored",))
def ml7_classification_report(spark, sf):
    return f32(metrics.classification_report(fx.scored(spark, sf)))


_ROC_CTE = """
sc AS (SELECT {g}score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
       FROM {src} WHERE score IS NOT NULL GROUP BY {g}score),
c AS (SELECT {g}score, pos, neg, row_number() OVER (PARTITION BY {p} ORDER BY score DESC) AS rank,
             sum(pos) OVER (PARTITION BY {p} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
             sum(neg) OVER (PARTITION BY {p} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps FROM sc),
t AS (SELECT {g}sum(pos) AS P, sum(neg) AS N, max(rank) AS m FROM c {gb}),
nx AS (SELECT c.*, lead(pos) OVER (PARTITION BY {p} ORDER BY rank) AS npos,
              lead(neg) OVER (PARTITION BY {p} ORDER BY rank) AS nneg FROM c),
pts AS (SELECT {gn}rank, score AS threshold, fps / N AS fpr, tps / P AS tpr FROM nx {join}
        WHERE NOT (rank > 1 AND rank < m AND m > 2 AND npos = pos AND nneg = neg)
        UNION ALL SELECT {g}0 AS rank, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM t)"""


@register("ml8_roc_curve", "WITH " + _ROC_CTE.format(g="", p="1", src="scored", gn="", join=", t", gb="")
          + "\nSELECT rank, threshold, CAST(fpr AS FLOAT) AS fpr, CAST(tpr AS FLOAT) AS tpr FROM pts", ("scored",))
def ml8_roc_curve(spark, sf):
    return f32(metrics.roc_curve(fx.scored(spark, sf)), ["fpr", "tpr"])


@register("ml9_auc", """
WITH sc AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
            FROM scored GROUP BY score),
c AS (SELECT pos, neg, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps FROM sc)
SELECT CAST(sum(neg * (2 * tps - pos)) / (2.0 * sum(neg) * sum(pos)) AS FLOAT) AS auc FROM c
""", ("scored",))
def ml9_auc(spark, sf):
    return f32(metrics.auc(fx.scored(spark, sf)))


_FOLD_ROC = ("WITH f AS (" + _FOLDS + "),"
             + _ROC_CTE.format(g="fold, ", p="fold", src="f", gn="nx.fold, ", join="JOIN t ON nx.fold = t.fold",
                               gb="GROUP BY fold"))


@register("ml9_auc_per_fold", _FOLD_ROC + """,
lg AS (SELECT fold, fpr, tpr, lag(fpr) OVER (PARTITION BY fold ORDER BY rank) AS px,
              lag(tpr) OVER (PARTITION BY fold ORDER BY rank) AS py FROM pts)
SELECT fold, CAST(sum((fpr - px) * (tpr + py) / 2) AS FLOAT) AS auc FROM lg GROUP BY fold
""", ("scored",))
def ml9_auc_per_fold(spark, sf):
    pts = metrics.roc_curve(_folds(spark, sf), group_cols=["fold"])
    return f32(metrics.auc_from_points(pts, ["fold"]))


@register("ml10_stratified_folds", _FOLDS, ("scored",))
def ml10_stratified_folds(spark, sf):
    return _folds(spark, sf).select("id", "label", "score", "fold")


@register("ml10_fold_class_counts", "WITH f AS (" + _FOLDS + ") SELECT fold, label, count(*) AS n FROM f GROUP BY fold, label",
          ("scored",))
def ml10_fold_class_counts(spark, sf):
    return _folds(spark, sf).groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


_GRID = """,
ix AS (SELECT *, lead(fpr) OVER (PARTITION BY fold ORDER BY rank) AS nx_, lead(tpr) OVER (PARTITION BY fold ORDER BY rank) AS ny_
       FROM pts),
g AS (SELECT CAST(range AS INTEGER) AS k, CASE WHEN range = 99 THEN 1.0 ELSE range * (CAST(1 AS DOUBLE) / 99) END AS grid
      FROM range(100)),
it AS (SELECT ix.fold, g.k, g.grid,
              CASE WHEN g.k = 0 THEN 0.0 WHEN nx_ IS NULL OR g.grid = fpr THEN tpr
                   ELSE (ny_ - tpr) / (nx_ - fpr) * (g.grid - fpr) + tpr END AS value
       FROM ix JOIN g ON g.grid >= ix.fpr AND (ix.nx_ IS NULL OR g.grid < ix.nx_)),
m AS (SELECT k, grid, CASE WHEN k = 99 THEN 1.0 ELSE avg(value) END AS mean_tpr, stddev_pop(value) AS std_tpr
      FROM it GROUP BY k, grid)"""


@register("ml12_mean_roc_grid", _FOLD_ROC + _GRID + """
SELECT k, CAST(grid AS FLOAT) AS fpr, CAST(mean_tpr AS FLOAT) AS mean_tpr, CAST(std_tpr AS FLOAT) AS std_tpr,
       CAST(least(mean_tpr + std_tpr, 1.0) AS FLOAT) AS tpr_upper, CAST(greatest(mean_tpr - std_tpr, 0.0) AS FLOAT) AS tpr_lower
FROM m
""", ("scored",))
def ml12_mean_roc_grid(spark, sf):
    pts = metrics.roc_curve(_folds(spark, sf), group_cols=["fold"])
    grid, _ = metrics.mean_roc(pts)
    return f32(grid)


@register("ml12_mean_roc_summary", _FOLD_ROC + _GRID + """,
ma AS (SELECT sum(a) AS mean_auc FROM (SELECT (grid - lag(grid) OVER (ORDER BY k)) * (mean_tpr + lag(mean_tpr) OVER (ORDER BY k)) / 2
                                       AS a FROM m)),
lg AS (SELECT fold, fpr, tpr, lag(fpr) OVER (PARTITION BY fold ORDER BY rank) AS px,
              lag(tpr) OVER (PARTITION BY fold ORDER BY rank) AS py FROM pts),
fa AS (SELECT fold, sum((fpr - px) * (tpr + py) / 2) AS auc FROM lg GROUP BY fold)
SELECT CAST(mean_auc AS FLOAT) AS mean_auc, CAST(stddev_pop(auc) AS FLOAT) AS std_auc, CAST(avg(auc) AS FLOAT) AS avg_fold_auc
FROM ma, fa GROUP BY mean_auc
""", ("scored",))
def ml12_mean_roc_summary(spark, sf):
    pts = metrics.roc_curve(_folds(spark, sf), group_cols=["fold"])
    _, summary = metrics.mean_roc(pts)
    return f32(summary)


@register("ml10_grouped_folds_price_rows", """
WITH g AS (SELECT id, churn FROM cust_churn),
f AS (SELECT id, CAST((row_number() OVER (PARTITION BY churn ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) - 1) % 3
             AS INTEGER) AS fold FROM g),
r AS (SELECT p.id, c.churn FROM prices p JOIN cust_churn c ON p.id = c.id)
SELECT f.fold, r.churn, count(*) AS n_rows, count(DISTINCT r.id) AS n_customers FROM r JOIN f ON r.id = f.id
GROUP BY f.fold, r.churn
""", ("cust_churn", "prices"))
def ml10_grouped_folds_price_rows(spark, sf):
    """Customer-grouped stratified folds over the price rows: every customer's rows share one fold."""
    rows = fx.prices(spark, sf).select("id").join(fx.churn_flags(spark, sf), "id")
    f = splits.grouped_stratified_folds(rows, "churn", "id", 3, 42)
    return f.groupBy("fold", "churn").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("id").alias("n_customers"))


@register("ml10_folds_null_labels_and_repeats", """
WITH p AS (SELECT CASE WHEN id % 11 <> 0 THEN churn END AS churn FROM cust_churn
           UNION ALL SELECT CASE WHEN id % 11 <> 0 THEN churn END FROM cust_churn WHERE id % 5 = 0),
c AS (SELECT churn, count(*) AS n FROM p GROUP BY churn),
f AS (SELECT churn, n, unnest(range(3)) AS fold FROM c)
SELECT churn, CAST(fold AS INTEGER) AS fold, CAST((n - fold + 2) // 3 AS BIGINT) AS n_rows FROM f
""", ("cust_churn",))
def ml10_folds_null_labels_and_repeats(spark, sf):
    """Fold sizes per class with NULL labels and repeated rows planted: no row is lost, every class is dealt evenly."""
    label = F.when(F.col("id") % 11 != 0, F.col("churn"))
    cc = fx.cust_churn(spark, sf).withColumn("churn", label)
    folded = splits.stratified_folds(cc.unionByName(cc.where("id % 5 = 0")), "churn", ["id"], 3)
    return folded.groupBy("churn", "fold").agg(F.count("*").alias("n_rows"))
