"""Classifier evaluation on a scored table (ML6-ML9, ML12).

Inputs are plain columns (label 0/1, predicted label, score), so every
metric works on any model's output and is checked against SQL.

ROC points need running totals in descending score order.  Instead of a
``Window.orderBy(score)`` over the whole table (one task), scores are first
reduced to one row per distinct score (map-side combine), and the running
totals come from ``ordered.prefix_sums`` (range partitions + offsets).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlab.operators import ordered
from churnlab.operators.joins import with_stats
from churnlab.session import materialize

GRID_POINTS = 100
#: Bins of a binned curve.
BINS = 1_000


def _safe(num, den):
    # sklearn returns 0 (with a warning) when a precision / recall is undefined
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """ML6: accuracy, precision and recall of class 1, one row."""
    y, p = F.col(label), F.col(prediction)
    c = df.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
               F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return c.select(_safe(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                    _safe(tp, tp + fp).alias("precision"), _safe(tp, tp + fn).alias("recall"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          classes: Sequence[int] = (0, 1)) -> DataFrame:
    """ML7: per-class precision / recall / F1 / support, accuracy, macro and weighted averages."""
    y, p = F.col(label), F.col(prediction)
    aggs = [F.count(F.lit(1)).alias("_n"), F.count_if(y == p).alias("_ok")]
    for c in classes:
        aggs += [F.count_if((y == c) & (p == c)).alias(f"_tp{c}"), F.count_if(p == c).alias(f"_pp{c}"),
                 F.count_if(y == c).alias(f"_s{c}")]
    one = df.agg(*aggs)
    per = {}
    for c in classes:
        pr = _safe(F.col(f"_tp{c}"), F.col(f"_pp{c}"))
        rc = _safe(F.col(f"_tp{c}"), F.col(f"_s{c}"))
        per[c] = (pr, rc, _safe(2 * pr * rc, pr + rc), F.col(f"_s{c}"))
    k = len(classes)
    n = F.col("_n")
    rows = [F.struct(F.lit(str(c)).alias("row"), pr.alias("precision"), rc.alias("recall"),
                     f1.alias("f1_score"), s.alias("support")) for c, (pr, rc, f1, s) in per.items()]
    rows.append(F.struct(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                         F.lit(None).cast("double").alias("recall"), _safe(F.col("_ok"), n).alias("f1_score"),
                         n.alias("support")))
    for name, weight in (("macro avg", None), ("weighted avg", True)):
        def avg(i):
            if weight is None:
                return sum((v[i] for v in per.values()), F.lit(0.0)) / F.lit(k)
            return _safe(sum((v[i] * v[3] for v in per.values()), F.lit(0.0)), n)
        rows.append(F.struct(F.lit(name).alias("row"), avg(0).alias("precision"), avg(1).alias("recall"),
                             avg(2).alias("f1_score"), n.alias("support")))
    return one.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def score_counts(df: DataFrame, label: str = "label", score: str = "score",
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """Positives / negatives per distinct score (per group), with running totals by score descending.

    Columns: groups..., score, pos, neg, rank (1 = highest score), tps, fps.
    """
    y = F.col(label)
    per = (df.where(F.col(score).isNotNull() & y.isNotNull())
             .groupBy(*group_cols, F.col(score).alias("score"))
             .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))
             .withColumn("_one", F.lit(1).cast("bigint")))
    cum = ordered.prefix_sums(per, list(group_cols), [F.col("score").desc()], ["pos", "neg", "_one"])
    return cum.select(*group_cols, "score", "pos", "neg", F.col("cum__one").alias("rank"),
                      F.col("cum_pos").alias("tps"), F.col("cum_neg").alias("fps"))


def roc_curve(df: DataFrame, label: str = "label", score: str = "score", group_cols: Sequence[str] = (),
              drop_intermediate: bool = True) -> DataFrame:
    """ML8: ROC points (groups..., rank, threshold, fpr, tpr) starting at (0, 0) with threshold +inf.

    Same points as scikit-learn's ``roc_curve``: one point per distinct
    score, and with ``drop_intermediate`` interior points whose neighbours
    make them collinear (same step in both counts as the next point) are
    dropped.  The next point is found by an equi-join on rank + 1, not a
    window over the whole table.
    """
    groups = list(group_cols)
    sc = score_counts(df, label, score, groups)
    tot = sc.groupBy(*groups).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"), F.max("rank").alias("_m"))
    pts = sc.join(tot, groups) if groups else with_stats(sc, tot)
    if drop_intermediate:
        nxt = sc.select(*groups, (F.col("rank") - 1).alias("rank"), F.col("pos").alias("_npos"),
                        F.col("neg").alias("_nneg"))
        pts = pts.join(nxt, [*groups, "rank"], "left")
        interior = (F.col("rank") > 1) & (F.col("rank") < F.col("_m")) & (F.col("_m") > 2)
        same = (F.col("_npos") == F.col("pos")) & (F.col("_nneg") == F.col("neg"))
        pts = pts.where(~(interior & same))
    pts = pts.select(*groups, "rank", F.col("score").alias("threshold"),
                     F.try_divide(F.col("fps"), F.col("_N")).alias("fpr"),
                     F.try_divide(F.col("tps"), F.col("_P")).alias("tpr"))
    origin = tot.select(*groups, F.lit(0).cast("bigint").alias("rank"), F.lit(float("inf")).alias("threshold"),
                        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts)


def auc(df: DataFrame, label: str = "label", score: str = "score", group_cols: Sequence[str] = (),
        name: str = "auc") -> DataFrame:
    """ML9: area under the ROC curve by the trapezoid rule, per group.

    Sum over distinct scores of neg_i * (2 * tps_i - pos_i) / (2 * N * P):
    the trapezoid between consecutive ROC points, no ordering step needed
    beyond the running totals.
    """
    groups = list(group_cols)
    sc = score_counts(df, label, score, groups)
    return sc.groupBy(*groups).agg(
        F.try_divide(F.sum(F.col("neg") * (2 * F.col("tps") - F.col("pos"))).cast("double"),
                     2.0 * F.sum("neg") * F.sum("pos")).alias(name))


def _numbered(points: DataFrame, groups: Sequence[str], order: str) -> DataFrame:
    return ordered.row_numbers(points, list(groups), [F.col(order)], "_i")


def _trapezoids(idx: DataFrame, groups: list[str], x: str, y: str, name: str) -> DataFrame:
    prev = idx.select(*groups, (F.col("_i") + 1).alias("_i"), F.col(x).alias("_px"), F.col(y).alias("_py"))
    j = idx.join(prev, [*groups, "_i"], "inner")
    return j.groupBy(*groups).agg(F.sum((F.col(x) - F.col("_px")) * (F.col(y) + F.col("_py")) / 2).alias(name))


def auc_from_points(points: DataFrame, group_cols: Sequence[str] = (), x: str = "fpr", y: str = "tpr",
                    order: str = "rank", name: str = "auc") -> DataFrame:
    """ML9 on given points: trapezoid sum over consecutive points (joined on the next position)."""
    return _trapezoids(_numbered(points, group_cols, order), list(group_cols), x, y, name)


def interpolate_on_grid(points: DataFrame, group_cols: Sequence[str] = ("fold",), n: int = GRID_POINTS,
                        x: str = "fpr", y: str = "tpr", order: str = "rank") -> DataFrame:
    """SF13: ``np.interp(linspace(0, 1, n), x, y)`` per group, output (groups..., k, grid, value).

    Each point owns the grid positions in [x_i, x_{i+1}) (the last point:
    x >= x_last), which it emits with ``explode`` - every grid position is
    produced exactly once per group, no pairing of points with the grid.
    Repeated x values resolve to the last point, as numpy does.
    """
    return _interpolated(_numbered(points, group_cols, order), list(group_cols), n, x, y)


def _interpolated(idx: DataFrame, groups: list[str], n: int, x: str, y: str) -> DataFrame:
    nxt = idx.select(*groups, (F.col("_i") - 1).alias("_i"), F.col(x).alias("_nx"), F.col(y).alias("_ny"))
    j = idx.join(nxt, [*groups, "_i"], "left")
    step = F.lit(1.0 / (n - 1))

    def grid(k):
        return F.when(k == n - 1, F.lit(1.0)).otherwise(k * step)

    kmin = F.greatest(F.floor(F.col(x) * (n - 1)) - 1, F.lit(0)).cast("int")
    kmax = F.when(F.col("_nx").isNull(), F.lit(n - 1)).otherwise(
        F.least(F.ceil(F.col("_nx") * (n - 1)) + 1, F.lit(n - 1))).cast("int")
    e = j.withColumn("k", F.explode(F.sequence(kmin, F.greatest(kmin, kmax))))
    g = grid(F.col("k"))
    owns = (g >= F.col(x)) & (F.col("_nx").isNull() | (g < F.col("_nx")))
    slope = (F.col("_ny") - F.col(y)) / (F.col("_nx") - F.col(x))
    val = F.when(F.col("_nx").isNull() | (g == F.col(x)), F.col(y)).otherwise(slope * (g - F.col(x)) + F.col(y))
    return e.where(owns).select(*groups, "k", g.alias("grid"), val.alias("value"))


def mean_roc(points: DataFrame, fold_col: str = "fold", n: int = GRID_POINTS) -> tuple[DataFrame, DataFrame]:
    """ML12: mean ROC over folds on an n-point grid, with +-1 std band, AUC of the mean and std of fold AUCs.

    Follows the reference steps: each fold's interpolated TPR starts at 0,
    the mean ends at 1, std is the population std, the band is clamped to
    [0, 1].  Returns (grid table, one-row summary).  The points are numbered
    once, for the grid and for the fold areas.
    """
    idx = materialize(_numbered(points.select(fold_col, "rank", "fpr", "tpr"), [fold_col], "rank"), "roc_points")
    it = _interpolated(idx, [fold_col], n, "fpr", "tpr")
    it = it.withColumn("value", F.when(F.col("k") == 0, F.lit(0.0)).otherwise(F.col("value")))
    g = it.groupBy("k", "grid").agg(F.avg("value").alias("mean_tpr"), F.stddev_pop("value").alias("std_tpr"))
    g = g.withColumn("mean_tpr", F.when(F.col("k") == n - 1, F.lit(1.0)).otherwise(F.col("mean_tpr")))
    g = g.withColumn("tpr_upper", F.least(F.col("mean_tpr") + F.col("std_tpr"), F.lit(1.0))) \
         .withColumn("tpr_lower", F.greatest(F.col("mean_tpr") - F.col("std_tpr"), F.lit(0.0)))
    # the grid has n rows: a window over it is bounded
    w = Window.orderBy("k")
    seg = g.withColumn("_a", (F.col("grid") - F.lag("grid").over(w)) *
                       (F.col("mean_tpr") + F.lag("mean_tpr").over(w)) / 2)
    fold_auc = _trapezoids(idx, [fold_col], "fpr", "tpr", "auc")
    summary = with_stats(seg.agg(F.sum("_a").alias("mean_auc")),
                         fold_auc.agg(F.stddev_pop("auc").alias("std_auc"), F.avg("auc").alias("avg_fold_auc")))
    return g.select("k", F.col("grid").alias("fpr"), "mean_tpr", "std_tpr", "tpr_upper", "tpr_lower"), summary


def _binned(df: DataFrame, label: str, score: str, bins: int, low: float, high: float, groups: list[str]) -> DataFrame:
    """(groups..., bin, pos, neg): fixed-width score counts; one aggregation, at most ``bins`` rows a group."""
    x, y = F.col(score).cast("double"), F.col(label)
    at = F.floor((F.least(F.greatest(x, F.lit(low)), F.lit(high)) - low) / (high - low) * bins)
    at = F.when(F.isnan(x), bins - 1).otherwise(F.least(at, F.lit(bins - 1)))      # NaN is the largest number
    return (df.where(x.isNotNull() & y.isNotNull()).groupBy(*groups, at.cast("int").alias("bin"))
            .agg(F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")))


def binned_roc(df: DataFrame, label: str = "label", score: str = "score", group_cols: Sequence[str] = (),
               bins: int = BINS, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """ML8 for very many distinct scores: the ROC points at the edges of ``bins`` equal score ranges.

    One aggregation with map-side combine and at most ``bins`` rows a group,
    where the exact curve orders every distinct score.  Columns: groups...,
    rank (0 = origin), threshold (the bin's lower edge), fpr, tpr, tpr_error.
    The points lie on the exact curve; between a point and the one before it,
    the exact curve leaves the straight line by at most ``tpr_error``, the
    bin's share of the positives.  Scores outside [low, high] count in the
    first or last bin, NaN in the last; null scores and labels are left out.
    """
    groups = list(group_cols)
    counts = _binned(df, label, score, bins, low, high, groups)
    down = Window.partitionBy(*groups).orderBy(F.col("bin").desc())      # at most ``bins`` rows a group
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = Window.partitionBy(*groups)
    cum = counts.select(*groups, F.row_number().over(down).cast("bigint").alias("rank"), "bin", "pos",
                        F.sum("pos").over(upto).alias("_tps"), F.sum("neg").over(upto).alias("_fps"),
                        F.sum("pos").over(all_rows).alias("_P"), F.sum("neg").over(all_rows).alias("_N"))
    points = cum.select(*groups, "rank", (F.lit(low) + F.col("bin") * ((high - low) / bins)).alias("threshold"),
                        F.try_divide(F.col("_fps"), F.col("_N")).alias("fpr"), F.try_divide(F.col("_tps"), F.col("_P")).alias("tpr"),
                        F.try_divide(F.col("pos"), F.col("_P")).alias("tpr_error"))
    origin = F.struct(F.lit(0).cast("bigint").alias("rank"), F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"),
                      F.lit(0.0).alias("tpr"), F.lit(0.0).alias("tpr_error"))
    point = F.struct("rank", "threshold", "fpr", "tpr", "tpr_error")
    # the first bin of a group brings the origin along
    both = F.when(F.col("rank") == 1, F.array(origin, point)).otherwise(F.array(point))
    return points.select(*groups, F.explode(both).alias("_p")).select(*groups, "_p.*")


def binned_auc(df: DataFrame, label: str = "label", score: str = "score", group_cols: Sequence[str] = (),
               bins: int = BINS, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """ML9 on binned scores: (groups..., auc, error); the exact area lies within ``auc`` +- ``error``.

    Pairs of a positive and a negative in different bins are in their exact
    order; pairs in one bin count half, so each is off by half a pair at most.
    """
    groups = list(group_cols)
    counts = _binned(df, label, score, bins, low, high, groups)
    upto = Window.partitionBy(*groups).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = counts.withColumn("_tps", F.sum("pos").over(upto))
    pairs = 2.0 * F.sum("neg") * F.sum("pos")
    return cum.groupBy(*groups).agg(
        F.try_divide(F.sum(F.col("neg") * (2 * F.col("_tps") - F.col("pos"))).cast("double"), pairs).alias("auc"),
        F.try_divide(F.sum(F.col("neg") * F.col("pos")).cast("double"), pairs).alias("error"))
