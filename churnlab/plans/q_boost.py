"""Registered queries: boosted trees checked number by number (ML3-ML5, ML8-ML9, ML11-ML17).

The model operators run on a compact customer table whose features have few
distinct values, so that every threshold between two values is a candidate
split and boosting can be restated in SQL: trees grown level by level by
variance gain, leaf means, pseudo-residuals of the logistic loss, shrunken
sums.  The SQL grows its own trees from the tables; scores, areas, the search's
ranking and the split counts must come out equal.  (Years count from two, as a
customer's single order would let two features make the very same split.)
"""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlab.operators import metrics, model, splits
from churnlab.plans.catalog import register
from churnlab.plans.util import rnd
from churnlab.session import materialize
from churnlab.sources import fixtures as fx

FEATURES = ["nb_orders", "nation", "gas", "years", "month"]
BASE = {"learning_rate": 0.3, "max_depth": 2, "n_estimators": 4}
GRID = {"n_estimators": [3], "max_depth": [1, 2, 3], "learning_rate": [0.1, 0.5]}
FOLDS = 3

_COMPACT = """
WITH compact AS (
  SELECT id, churn, nb_prod_act AS f0, CASE WHEN activity_new IS NULL THEN -1 ELSE CAST(substr(activity_new, 8) AS INTEGER) END AS f1,
         CASE has_gas WHEN 't' THEN 1 ELSE 0 END AS f2, greatest(year(CAST(date_end AS DATE)) - year(CAST(date_activ AS DATE)), 2) AS f3,
         month(CAST(date_activ AS DATE)) AS f4, md5('42:' || CAST(id AS VARCHAR)) AS h FROM cust_churn),
base AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY churn ORDER BY h, id) - 1) % 3 AS INTEGER) AS fold,
         CASE WHEN CAST('0x' || substr(h, 1, 8) AS BIGINT) % 10000 < 3300 THEN 1 ELSE 0 END AS is_test FROM compact),
u AS (""" + " UNION ALL ".join(f"SELECT id, {i} AS f, CAST(f{i} AS DOUBLE) AS v FROM base" for i in range(len(FEATURES))) + ")"


def boosted_sql(models: str, trees: int, depth: int) -> str:
    """CTEs that boost ``trees`` trees for each row of ``models``.

    ``models``: SQL of (m, id, y, train, depth, lr), a row per model and
    customer; y is -1 or 1.  Result: s<trees> (m, id, y, train, score, r) and
    splits (m, f), a row per split of a tree.
    """
    out = [f"rows AS MATERIALIZED ({models})",
           """cand AS MATERIALIZED (
  SELECT m, f, (v + next) / 2 AS thr FROM (
    SELECT m, f, v, lead(v) OVER (PARTITION BY m, f ORDER BY v) AS next
    FROM (SELECT DISTINCT r.m, u.f, u.v FROM rows r JOIN u USING (id) WHERE r.train)) WHERE next IS NOT NULL)""",
           "s0 AS MATERIALIZED (SELECT m, id, y, train, depth, lr, CAST(0 AS DOUBLE) AS score, CAST(y AS DOUBLE) AS r FROM rows)"]
    var = "({q} - {s} * {s} / {c}) / {c}"
    left, whole = var.format(q="ql", s="sl", c="cl"), var.format(q="q", s="s", c="c")
    right = var.format(q="(q - ql)", s="(s - sl)", c="(c - cl)")
    for t in range(trees):
        out.append(f"a{t}_0 AS (SELECT m, id, 1 AS node FROM s{t})")
        for k in range(depth):
            out.append(f"""h{t}_{k} AS MATERIALIZED (
  SELECT a.m, a.node, u.f, u.v, count(*) AS c, sum(s.r) AS s, sum(s.r * s.r) AS q
  FROM a{t}_{k} a JOIN s{t} s ON s.m = a.m AND s.id = a.id JOIN u ON u.id = a.id
  WHERE s.train AND a.node >= {2 ** k} AND s.depth > {k} GROUP BY ALL)""")
            out.append(f"""b{t}_{k} AS MATERIALIZED (
  SELECT m, node, f, thr FROM (
    SELECT *, row_number() OVER (PARTITION BY m, node ORDER BY round(gain, 11) DESC, f, thr) AS place FROM (
      SELECT *, {whole} - cl / c * {left} - (c - cl) / c * {right} AS gain FROM (
        SELECT h.m, h.node, h.f, cand.thr, sum(h.c) AS c, sum(h.s) AS s, sum(h.q) AS q, coalesce(sum(h.c) FILTER (h.v <= cand.thr), 0) AS cl,
               sum(h.s) FILTER (h.v <= cand.thr) AS sl, sum(h.q) FILTER (h.v <= cand.thr) AS ql
        FROM h{t}_{k} h JOIN cand ON cand.m = h.m AND cand.f = h.f GROUP BY ALL) WHERE cl > 0 AND cl < c)
    WHERE gain >= {model.MIN_GAIN}) WHERE place = 1)""")
            out.append(f"""a{t}_{k + 1} AS MATERIALIZED (
  SELECT a.m, a.id, CASE WHEN b.f IS NULL THEN a.node ELSE 2 * a.node + CASE WHEN u.v <= b.thr THEN 0 ELSE 1 END END AS node
  FROM a{t}_{k} a LEFT JOIN b{t}_{k} b ON b.m = a.m AND b.node = a.node LEFT JOIN u ON u.id = a.id AND u.f = b.f)""")
        weight = "1" if t == 0 else "lr"
        out.append(f"""s{t + 1} AS MATERIALIZED (
  SELECT m, id, y, train, depth, lr, score, 4 * y / (1 + exp(2 * y * score)) AS r FROM (
    SELECT s.m, s.id, s.y, s.train, s.depth, s.lr, s.score + s.{weight} * p.mean AS score
    FROM s{t} s JOIN a{t}_{depth} a ON a.m = s.m AND a.id = s.id
    JOIN (SELECT a.m, a.node, avg(s.r) AS mean FROM a{t}_{depth} a JOIN s{t} s ON s.m = a.m AND s.id = a.id
          WHERE s.train GROUP BY ALL) p ON p.m = a.m AND p.node = a.node))""".replace("s.1 *", "1 *"))
    out.append("splits AS (" + " UNION ALL ".join(f"SELECT m, f FROM b{t}_{k}" for t in range(trees) for k in range(depth)) + ")")
    return ",\n".join(out)


def _areas(scores: str) -> str:
    """CTE area (m, train, auc): positives above negatives, ties half, of the scores of each model and side."""
    return f"""counts AS (SELECT m, train, round(score, 9) AS score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = -1) AS neg
  FROM {scores} GROUP BY ALL),
area AS (SELECT m, train, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY m, train ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM counts) GROUP BY m, train)"""


def _rows_sql(m: str, train: str, depth: str, lr: str, source: str = "base") -> str:
    return f"SELECT {m} AS m, id, 2 * churn - 1 AS y, {train} AS train, {depth} AS depth, CAST({lr} AS DOUBLE) AS lr FROM {source}"


_HOLDOUT = boosted_sql(_rows_sql("0", "is_test = 0", str(BASE["max_depth"]), str(BASE["learning_rate"])),
                       BASE["n_estimators"], BASE["max_depth"])
_CV = boosted_sql(_rows_sql("k", "fold <> k", str(BASE["max_depth"]), str(BASE["learning_rate"]), f"base, range({FOLDS}) AS g(k)"),
                  BASE["n_estimators"], BASE["max_depth"])
_CANDIDATES = ", ".join(f"({i}, {c['max_depth']}, {c['learning_rate']})" for i, c in enumerate(model.param_grid(GRID)))
_PARAMS = ", ".join(f"({i}, $${c}$$)" for i, c in enumerate(model.param_grid(GRID)))
# the search fits on the training side: model 10 * candidate + fold
_SEARCH = boosted_sql(_rows_sql("10 * c + k", "fold <> k", "d", "rate",
                                f"base, range({FOLDS}) AS g(k), (VALUES {_CANDIDATES}) AS n(c, d, rate) WHERE is_test = 0"),
                      GRID["n_estimators"][0], max(GRID["max_depth"]))
_LAST = f"s{BASE['n_estimators']}"
_FOUND = f"s{GRID['n_estimators'][0]}"
_RANKED = _areas(f"(SELECT * FROM {_FOUND} WHERE NOT train)") + """,
means AS (SELECT m // 10 AS candidate, avg(auc) AS mean_auc FROM area GROUP BY 1),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY round(mean_auc, 9) DESC, candidate) AS INTEGER) AS rank FROM means)"""


def _compact(spark, sf):
    c = fx.cust_churn(spark, sf)
    end, start = (F.col(x).cast("date") for x in ("date_end", "date_activ"))
    data = c.select("id", "churn", F.col("nb_prod_act").alias("nb_orders"),
                    F.coalesce(F.expr("cast(substring(activity_new, 8) as int)"), F.lit(-1)).alias("nation"),
                    F.when(F.col("has_gas") == "t", 1).otherwise(0).alias("gas"),
                    F.greatest(F.year(end) - F.year(start), F.lit(2)).alias("years"), F.month(start).alias("month"))
    data = splits.stratified_folds(data, "churn", ["id"], FOLDS, 42, unique_keys=True)
    return materialize(splits.train_test_split(data, ["id"]), "compact")


def _holdout(spark, sf):
    data = _compact(spark, sf)
    fitted = model.fit(data.where("is_test = 0"), FEATURES, BASE)
    return materialize(model.predict(fitted, data.where("is_test = 1"), ["id", "churn"]), "compact_predictions")


@register("ml3_ml5_boosted_scores", f"""{_COMPACT},
{_HOLDOUT}
SELECT id, CAST((y + 1) // 2 AS INTEGER) AS churn, CAST(CASE WHEN score > 0 THEN 1 ELSE 0 END AS INTEGER) AS prediction,
       round(1 / (1 + exp(-2 * score)), 6) AS p_churn FROM {_LAST} WHERE NOT train""", ("cust_churn",))
def ml3_ml5_boosted_scores(spark, sf):
    """Class and probability of every hold-out customer."""
    return rnd(_holdout(spark, sf))


@register("ml8_ml9_boosted_auc", f"""{_COMPACT},
{_HOLDOUT},
{_areas(f"(SELECT * FROM {_LAST} WHERE NOT train)")}
SELECT round(auc, 6) AS auc FROM area""", ("cust_churn",))
def ml8_ml9_boosted_auc(spark, sf):
    scored = _holdout(spark, sf).select(F.col("churn").alias("label"), F.col("p_churn").alias("score"))
    return rnd(metrics.auc(scored))


@register("ml11_boosted_cv_auc", f"""{_COMPACT},
{_CV},
{_areas(_LAST)}
SELECT CAST(m AS INTEGER) AS fold, round(max(auc) FILTER (train), 6) AS auc_train, round(max(auc) FILTER (NOT train), 6) AS auc_test
FROM area GROUP BY m""", ("cust_churn",))
def ml11_boosted_cv_auc(spark, sf):
    """Train and test area of every fold."""
    return rnd(model.cross_validate(_compact(spark, sf), FEATURES, BASE)[0])


@register("ml13_ml15_boosted_search", f"""{_COMPACT},
{_SEARCH},
{_RANKED}
SELECT CAST(candidate AS INTEGER) AS candidate, p.params, round(mean_auc, 6) AS mean_auc, rank
FROM ranked JOIN (VALUES {_PARAMS}) AS p(candidate, params) USING (candidate)""", ("cust_churn",))
def ml13_ml15_boosted_search(spark, sf):
    """The search's table: parameters, mean area over the folds, rank."""
    data = _compact(spark, sf).where("is_test = 0")
    table, _ = model.grid_search(data, FEATURES, GRID, k=FOLDS, parallelism=4)
    return rnd(table.select("candidate", "params", "mean_auc", "rank"))


# the winner's models, fitted on all customers
_REFIT = boosted_sql(_rows_sql("100 + k", "fold <> k", "d", "rate",
                               f"base, range({FOLDS}) AS g(k), (SELECT d, rate FROM ranked JOIN (VALUES {_CANDIDATES}) AS n(c, d, rate) "
                               "ON c = candidate WHERE rank = 1)"), GRID["n_estimators"][0], max(GRID["max_depth"]))


def _again(sql: str) -> str:
    """The CTEs of a second boosting beside the first: every name gets a ``z``."""
    import re
    names = re.findall(r"(?m)^(\w+) AS (?:MATERIALIZED )?\(", sql)
    return re.sub(r"\b(" + "|".join(names) + r")\b(?!\()", r"z\1", sql)


@register("ml16_boosted_best_refit_auc", f"""{_COMPACT},
{_SEARCH},
{_RANKED},
{_again(_REFIT)},
{_again(_areas(_FOUND)).replace(f"FROM {_FOUND}", f"FROM z{_FOUND}")}
SELECT CAST(m - 100 AS INTEGER) AS fold, round(max(auc) FILTER (train), 6) AS auc_train, round(max(auc) FILTER (NOT train), 6) AS auc_test
FROM zarea GROUP BY m""", ("cust_churn",))
def ml16_boosted_best_refit_auc(spark, sf):
    """The best candidate of the search, refitted over the folds of all customers."""
    data = _compact(spark, sf)
    _, best = model.grid_search(data.where("is_test = 0"), FEATURES, GRID, k=FOLDS, parallelism=4)
    return rnd(model.cross_validate(data, FEATURES, best, k=FOLDS)[0])


_NAMES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(FEATURES))


@register("ml17_boosted_split_counts", f"""{_COMPACT},
{_CV}
SELECT n.feature, count(*) AS splits, CAST(rank() OVER (ORDER BY count(*) DESC, n.feature) AS INTEGER) AS rank
FROM splits JOIN (VALUES {_NAMES}) AS n(f, feature) USING (f) WHERE m = {FOLDS - 1} GROUP BY n.feature""", ("cust_churn",))
def ml17_boosted_split_counts(spark, sf):
    """How often the last fold's trees split by each feature, ranked."""
    last = model.cross_validate(_compact(spark, sf), FEATURES, BASE, k=FOLDS)[2]
    return model.split_counts(last, FEATURES)


@register("ml14_selection_scores", """
WITH c AS (
  SELECT label, unnest([score, floor(score * 20) / 20, score + ((id * 7) % 11) / 40.0, 1 - score, 0.5]) AS score,
         unnest(range(5)) AS candidate FROM scored),
n AS (SELECT candidate, round(score, 9) AS score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM c GROUP BY ALL),
a AS (SELECT candidate, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY candidate ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM n) GROUP BY candidate)
SELECT CAST(candidate AS INTEGER) AS candidate, round(auc, 6) AS auc,
       CAST(row_number() OVER (ORDER BY round(auc, 9) DESC, candidate) AS INTEGER) AS rank FROM a""", ("scored",))
def ml14_selection_scores(spark, sf):
    """The search's exact selection score for five scorings of the same rows: as they are, in 20 steps, shifted, reversed, constant."""
    s = materialize(fx.scored(spark, sf), "scored")
    score = F.col("score")
    scorings = [score, F.floor(score * 20) / 20, score + (F.col("id") * 7 % 11) / 40.0, 1 - score, F.lit(0.5)]
    evaluator = model.ExactAUC("label", "candidate_score")
    tasks = [lambda x=x: evaluator.evaluate(s.select("label", F.round(x, 9).alias("candidate_score"))) for x in scorings]
    rows = list(enumerate(model.side_by_side(spark, tasks)))
    best = sorted(rows, key=lambda r: (-round(r[1], 9), r[0]))
    table = spark.createDataFrame([(i, a, best.index((i, a)) + 1) for i, a in rows], "candidate int, auc double, rank int")
    return rnd(table)
