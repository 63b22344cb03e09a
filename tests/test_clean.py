import numpy as np
import pytest

from churnlab.operators import clean


def _ref(vals, z=3.0, policy="omit"):
    """Plain numpy version of the reference's z-score replacement steps."""
    x = np.array([np.nan if v is None else v for v in vals], dtype=float)
    if policy == "propagate" and np.isnan(x).any():
        return x
    nn = x[~np.isnan(x)]
    mu, sd = nn.mean(), nn.std()
    zs = (x - mu) / sd
    m = x[np.abs(zs) < z].mean()
    f = np.where(np.isnan(x), m, x)
    z2 = (f - f.mean()) / f.std()
    return np.where(np.abs(z2) > z, m, f)


VALS = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0, 12.0, 1000.0, None]
CLEAN = [float(v) for v in range(1, 15)] + [500.0]


@pytest.mark.parametrize("policy", ["omit", "propagate"])
def test_replace_outliers_matches_reference_steps(spark, policy):
    data = [(i, VALS[i], CLEAN[i]) for i in range(len(VALS))]
    df = spark.createDataFrame(data, "id int, x double, y double")
    out, rep = clean.replace_outliers_zscore(df, ["x", "y"], null_policy=policy)
    got = {r["id"]: (r["x"], r["y"]) for r in out.collect()}
    ex, ey = _ref(VALS, policy=policy), _ref(CLEAN[:len(VALS)], policy=policy)
    for i in range(len(VALS)):
        gx, gy = got[i]
        if np.isnan(ex[i]):
            assert gx is None
        else:
            assert abs(gx - ex[i]) < 1e-9, (i, gx, ex[i])
        assert abs(gy - ey[i]) < 1e-9
    r = {row["column"]: row for row in rep.collect()}
    assert r["x"]["n_null"] == 1 and r["y"]["n_null"] == 0
    if policy == "omit":
        assert got[12][0] != 1000.0 and got[13][0] is not None


def test_constant_column_untouched(spark):
    df = spark.createDataFrame([(i, 5.0) for i in range(5)] + [(9, None)], "id int, x double")
    out, _ = clean.replace_outliers_zscore(df, ["x"])
    assert sorted((r["x"] for r in out.collect()), key=lambda v: (v is None, v)) == [5.0] * 5 + [None]


def test_mode_fill_and_median_fill(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (2, "a", None), (3, "b", 3.0), (4, "a", 10.0), (5, None, -4.0)],
                               "id int, d string, p double")
    m = {r["id"]: r["d"] for r in clean.fill_with_mode(df, ["d"]).collect()}
    assert m[5] == "a"  # tie between a and b: smallest
    f = {r["id"]: r["p"] for r in clean.fill_with_median(df, ["p"]).collect()}
    assert f[2] == 2.0  # median of 1, 3, 10, -4
    n = {r["id"]: r["p"] for r in clean.negatives_to_median(clean.fill_with_median(df, ["p"]), ["p"]).collect()}
    assert n[5] == 2.0  # median of 1, 2, 3, 10, -4 taken with the negative included


def test_drop_sparse_threshold(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, "x"), (3, None, "y")], "id int, a string, b string")
    assert clean.drop_sparse(df, 60.0).columns == ["id", "b"]
    assert clean.drop_sparse(df, columns=["b"]).columns == ["id", "a"]


def test_iqr_fences_and_removals(spark):
    xs = [float(v) for v in range(1, 21)] + [100.0]
    df = spark.createDataFrame([(v,) for v in xs], "x double")
    f = clean.iqr_fences(df, "x").first()
    q1, q3 = np.percentile(xs, [25, 75])
    assert abs(f["iqr"] - (q3 - q1)) < 1e-12 and abs(f["upper_bound"] - (q3 + 1.5 * (q3 - q1))) < 1e-12
    assert clean.remove_outliers_iqr(df, "x").count() == 20
    assert clean.remove_outliers_zscore(df, "x").count() == 20


def test_negatives_to_null(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (2.0,)], "x double")
    assert [r["x"] for r in clean.negatives_to_null(df, ["x"]).collect()] == [None, 0.0, 2.0]


def test_fill_and_fix_equals_two_steps(spark):
    import random
    rnd = random.Random(12)
    for n in (7, 8, 41, 42):
        data = [(i, None if rnd.random() < 0.2 else round(rnd.gauss(0, 3), 1),
                 None if rnd.random() < 0.3 else round(rnd.gauss(1, 2), 1)) for i in range(n)]
        df = spark.createDataFrame(data, "id int, a double, b double")
        two = clean.negatives_to_median(clean.fill_with_median(df, ["a", "b"]), ["a", "b"])
        one = clean.fill_and_fix_with_median(df, ["a", "b"], ["a", "b"])
        assert sorted(tuple(r) for r in two.collect()) == sorted(tuple(r) for r in one.collect())
