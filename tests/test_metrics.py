import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from churnlab.operators import metrics, splits


def sk_roc(y, s, drop=True):
    """scikit-learn's roc_curve algorithm in numpy (sklearn is not installed here)."""
    y, s = np.asarray(y), np.asarray(s, dtype=float)
    order = np.argsort(-s, kind="mergesort")
    y, s = y[order], s[order]
    idx = np.r_[np.where(np.diff(s))[0], y.size - 1]
    tps = np.cumsum(y)[idx]
    fps = 1 + idx - tps
    thr = s[idx]
    if drop and len(fps) > 2:
        keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
        fps, tps, thr = fps[keep], tps[keep], thr[keep]
    tps, fps, thr = np.r_[0, tps], np.r_[0, fps], np.r_[np.inf, thr]
    return fps / fps[-1], tps / tps[-1], thr


def _data(seed=5, n=400):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        y = 1 if rnd.random() < 0.3 else 0
        s = round(min(1.0, max(0.0, rnd.gauss(0.35 + 0.3 * y, 0.2))), 1)  # heavy ties
        out.append((i, y, s))
    return out


def test_roc_curve_matches_sklearn_algorithm(spark):
    data = _data()
    df = spark.createDataFrame(data, "id int, label int, score double")
    got = sorted((r["rank"], r["threshold"], r["fpr"], r["tpr"]) for r in metrics.roc_curve(df).collect())
    fpr, tpr, thr = sk_roc([d[1] for d in data], [d[2] for d in data])
    assert len(got) == len(fpr)
    for (_, t, f, p), ef, ep, et in zip(got, fpr, tpr, thr):
        assert t == et and abs(f - ef) < 1e-12 and abs(p - ep) < 1e-12


def test_auc_matches_trapezoid(spark):
    data = _data(9)
    df = spark.createDataFrame(data, "id int, label int, score double")
    fpr, tpr, _ = sk_roc([d[1] for d in data], [d[2] for d in data], drop=False)
    exp = float(np.sum(np.diff(fpr) * (tpr[1:] + tpr[:-1]) / 2))
    assert abs(metrics.auc(df).first()["auc"] - exp) < 1e-12
    pts = metrics.roc_curve(df)
    assert abs(metrics.auc_from_points(pts).first()["auc"] - exp) < 1e-12


def test_binary_metrics_and_report(spark):
    data = [(1, 1), (1, 0), (0, 0), (0, 0), (0, 1), (1, 1)]
    df = spark.createDataFrame(data, "label int, prediction int")
    m = metrics.binary_metrics(df).first()
    assert (m["accuracy"], m["precision"], m["recall"]) == (4 / 6, 2 / 3, 2 / 3)
    rep = {r["row"]: r for r in metrics.classification_report(df).collect()}
    assert rep["accuracy"]["f1_score"] == 4 / 6 and rep["0"]["support"] == 3
    assert abs(rep["macro avg"]["precision"] - 2 / 3) < 1e-12


def test_mean_roc_matches_numpy(spark):
    data = _data(11, 600)
    df = spark.createDataFrame(data, "id int, label int, score double")
    folded = splits.stratified_folds(df, "label", ["id"], 3, 42)
    fold_rows = {r["id"]: r["fold"] for r in folded.collect()}
    pts = metrics.roc_curve(folded, group_cols=["fold"])
    grid, summary = metrics.mean_roc(pts)
    mean_fpr = np.linspace(0, 1, 100)
    tprs, aucs = [], []
    for f in range(3):
        sub = [d for d in data if fold_rows[d[0]] == f]
        fpr, tpr, _ = sk_roc([d[1] for d in sub], [d[2] for d in sub])
        t = np.interp(mean_fpr, fpr, tpr)
        t[0] = 0.0
        tprs.append(t)
        aucs.append(float(np.sum(np.diff(fpr) * (tpr[1:] + tpr[:-1]) / 2)))
    mean_tpr = np.mean(tprs, axis=0)
    mean_tpr[-1] = 1.0
    std_tpr = np.std(tprs, axis=0)
    g = {r["k"]: r for r in grid.collect()}
    for k in range(100):
        assert abs(g[k]["mean_tpr"] - mean_tpr[k]) < 1e-9
        assert abs(g[k]["std_tpr"] - std_tpr[k]) < 1e-9
        assert abs(g[k]["tpr_upper"] - min(mean_tpr[k] + std_tpr[k], 1)) < 1e-9
    s = summary.first()
    exp_auc = float(np.sum(np.diff(mean_fpr) * (mean_tpr[1:] + mean_tpr[:-1]) / 2))
    assert abs(s["mean_auc"] - exp_auc) < 1e-9 and abs(s["std_auc"] - np.std(aucs)) < 1e-9


def test_folds_balanced_and_split_share(spark):
    df = spark.createDataFrame([(i, 1 if i % 10 == 0 else 0) for i in range(3000)], "id int, label int")
    f = splits.stratified_folds(df, "label", ["id"], 3)
    counts = {(r["fold"], r["label"]): r["count"] for r in f.groupBy("fold", "label").count().collect()}
    assert {counts[(k, 1)] for k in range(3)} == {100} and {counts[(k, 0)] for k in range(3)} == {900}
    share = splits.train_test_split(df, ["id"]).agg({"is_test": "avg"}).first()[0]
    assert 0.30 < share < 0.36


def test_hash_folds_near_balanced(spark):
    df = spark.createDataFrame([(i, 1 if i % 10 == 0 else 0) for i in range(6000)], "id int, label int")
    f = splits.stratified_folds(df, "label", ["id"], 3, exact=False)
    counts = {r["fold"]: r["count"] for r in f.groupBy("fold").count().collect()}
    assert set(counts) == {0, 1, 2} and all(1800 < c < 2200 for c in counts.values())


def test_folds_with_repeated_keys_keep_every_row(spark):
    data = [(i // 3, i % 2) for i in range(900)]  # every key three times
    df = spark.createDataFrame(data, "id int, label int")
    f = splits.stratified_folds(df, "label", ["id"], 3)
    assert f.count() == 900
    counts = {(r["fold"], r["label"]): r["count"] for r in f.groupBy("fold", "label").count().collect()}
    assert set(counts.values()) == {150}
    u = splits.stratified_folds(df.dropDuplicates(["id"]), "label", ["id"], 3, unique_keys=True)
    assert u.count() == 300


def test_grouped_folds_keep_customers_together(spark):
    data = [(i // 4, 1 if (i // 4) % 3 == 0 else 0, i) for i in range(1200)]  # 300 customers x 4 rows
    df = spark.createDataFrame(data, "id int, label int, r int")
    f = splits.grouped_stratified_folds(df, "label", "id", 3)
    assert f.count() == 1200
    assert f.select("id", "fold").distinct().count() == 300  # one fold per customer
    per_fold = {(r["fold"], r["label"]): r["count"]
                for r in f.select("id", "fold", "label").distinct().groupBy("fold", "label").count().collect()}
    assert sorted(per_fold[(k, 1)] for k in range(3)) == [33, 33, 34]
    assert sorted(per_fold[(k, 0)] for k in range(3)) == [66, 67, 67]


def test_binned_curve_lies_on_the_exact_one_and_within_its_bound(spark):
    rng = np.random.default_rng(12)
    y = rng.integers(0, 2, 3000)
    score = np.clip(rng.normal(.4 + .2 * y, .25, 3000), -.2, 1.3)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, score)] + [(1, None), (None, .5), (1, float("nan"))], "label int, score double")
    pos, neg = np.r_[score[y == 1], 9.0], score[y == 0]
    exact = ((pos[:, None] > neg[None]) + .5 * (pos[:, None] == neg[None])).mean()
    for bins in (1, 7, 400):
        r = metrics.binned_auc(df, bins=bins).first()
        assert abs(r.auc - exact) <= r.error + 1e-12
        points = metrics.binned_roc(df, bins=bins).orderBy("rank").collect()
        assert (points[0].fpr, points[0].tpr, points[-1].fpr, points[-1].tpr) == (0, 0, 1, 1)
        for p, q in zip(points, points[1:], strict=False):
            t = q.threshold if q is not points[-1] else -9.0
            assert abs(q.tpr - (pos >= t).mean()) < 1e-12 and abs(q.fpr - (neg >= t).mean()) < 1e-12
            inside = [s for s in pos if q.threshold <= s < p.threshold]
            assert all((pos >= s).mean() - p.tpr <= q.tpr_error + 1e-12 for s in inside)
    area = metrics.auc_from_points(metrics.binned_roc(df, bins=400)).first()[0]
    assert abs(area - metrics.binned_auc(df, bins=400).first().auc) < 1e-12
    assert metrics.binned_roc(df.where("false")).count() == 0


def test_exact_split_sizes_ties_and_order(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k"), F.lit("x").alias("_t"))
    for size in (0.33, 0.001, 1.0, 0.0):
        got = splits.exact_train_test_split(df, ["id"], size).collect()
        h = sorted((int(hashlib.md5(f"42:{r.id}".encode()).hexdigest()[:15], 16), r.id) for r in got)
        want = {i for _, i in h[:math.ceil(size * 1000)]}
        assert {r.id for r in got if r.is_test} == want
    # seven keys: the key at the cut is divided; a null key and identical rows are in order too
    odd = df.withColumn("k", F.when(F.col("k") > 0, F.col("k"))).select("k", "_t").unionByName(df.limit(0).select("k", "_t"))
    got = splits.exact_train_test_split(odd, ["k"], 0.5).groupBy("is_test").count().collect()
    assert {r.is_test: r["count"] for r in got} == {1: 500, 0: 500}
    assert splits.exact_train_test_split(df.limit(0), ["id"]).collect() == []


def test_kth_smallest_by_passes(spark, monkeypatch):
    monkeypatch.setattr(splits, "LISTED", 4)
    monkeypatch.setattr(splits, "RANGES", 8)
    values = sorted([5] * 40 + [2 ** 59 + 3] * 3 + list(range(0, 400, 7)))
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for k in (1, 30, 57, len(values)):
        v, below, equal, _ = splits.kth_smallest(df, "x", lambda n: k)
        assert v == values[k - 1] and below == values.index(v) and equal == values.count(v)
