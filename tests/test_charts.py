import math
import random

import numpy as np

from churnlab.operators import charts


def test_histogram_matches_numpy(spark):
    rnd = random.Random(4)
    xs = [round(rnd.lognormvariate(2, 1), 2) for _ in range(997)] + [0.0, 0.0]
    labels = [rnd.randint(0, 1) for _ in xs]
    df = spark.createDataFrame(list(zip(xs, labels)), "x double, churn int")
    got = {r["bin"]: r for r in charts.histogram_by_class(df, "x", bins=50).collect()}
    edges = np.histogram_bin_edges(np.array(xs), bins=50)
    for cls, name in ((0, "class_0"), (1, "class_1")):
        counts, _ = np.histogram([x for x, y in zip(xs, labels) if y == cls], bins=edges)
        assert [got[b][name] for b in range(50)] == counts.tolist()
    assert abs(got[49]["bin_end"] - max(xs)) < 1e-12 and got[0]["bin_start"] == 0.0


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(5.0, 0), (5.0, 1)], "x double, churn int")
    rows = {r["bin"]: r for r in charts.histogram_by_class(df, "x", bins=10).collect()}
    counts, edges = np.histogram([5.0, 5.0], bins=10)
    assert sum(rows[b]["class_0"] + rows[b]["class_1"] for b in range(10)) == 2
    assert rows[0]["bin_start"] == edges[0] == 4.5


def test_box_stats_match_matplotlib_rule(spark):
    rnd = random.Random(8)
    xs = [rnd.gauss(0, 1) for _ in range(500)] + [8.0, -9.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    b = charts.box_stats(df, "x").first()
    q1, med, q3 = np.percentile(xs, [25, 50, 75])
    iqr = q3 - q1
    arr = np.array(xs)
    lo = arr[arr >= q1 - 1.5 * iqr].min()
    hi = arr[arr <= q3 + 1.5 * iqr].max()
    assert abs(b["q1"] - q1) < 1e-12 and abs(b["median"] - med) < 1e-12
    assert abs(b["whisker_low"] - lo) < 1e-12 and abs(b["whisker_high"] - hi) < 1e-12
    assert b["n_outliers"] == int(((arr < q1 - 1.5 * iqr) | (arr > q3 + 1.5 * iqr)).sum())


def test_density_matches_direct_gaussian_kde(spark):
    rnd = random.Random(2)
    xs = [rnd.gauss(3, 2) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = sorted((r["k"], r["x"], r["density"]) for r in charts.density(df, "x").collect())
    arr = np.array(xs)
    bw = arr.std(ddof=1) * len(arr) ** (-0.2)  # Scott's factor times the sample std
    grid = np.linspace(arr.min() - 3 * bw, arr.max() + 3 * bw, 100)
    dens = np.exp(-0.5 * ((grid[:, None] - arr[None, :]) / bw) ** 2).sum(axis=1) / (len(arr) * bw * math.sqrt(2 * math.pi))
    assert len(got) == 100
    for (k, x, d), gx, gd in zip(got, grid, dens):
        assert abs(x - gx) < 1e-9 and abs(d - gd) < 1e-9 * max(1.0, gd)


def test_density_of_a_constant_column_is_null(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    got = charts.density(df, "x", gridsize=4).collect()
    assert len(got) == 4 and all(r["density"] is None for r in got)


def test_binned_density_is_within_its_bound(spark):
    rng = np.random.default_rng(5)
    values = np.r_[rng.normal(0, 1, 3000), rng.normal(9, .2, 500)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    exact = {r.k: r for r in charts.density(df, "x").collect()}
    errors = []
    for bins in (20, 400):
        rows = charts.density_binned(df, "x", bins=bins).collect()
        assert len(rows) == 100
        for r in rows:
            assert abs(r.x - exact[r.k].x) < 1e-9 and abs(r.density - exact[r.k].density) <= r.error + 1e-12
        errors.append(rows[0].error)
    assert abs(errors[0] / errors[1] - 400) < 1e-6
    assert all(r.density is None for r in charts.density_binned(df.where("x is null or x = 0.5"), "x").collect())
