import numpy as np
import pandas as pd

from churnlab.operators import profile, project


def _pdf():
    rng = np.random.default_rng(1)
    a = rng.normal(10, 3, 300)
    b = a * 0.5 + rng.normal(0, 1, 300)
    c = rng.normal(0, 1, 300)
    b[::7] = np.nan
    c[::11] = np.nan
    return pd.DataFrame({"a": a, "b": b, "c": c})


def test_describe_matches_pandas(spark):
    pdf = _pdf()
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double")
    got = {r["column"]: r for r in profile.describe(df).collect()}
    exp = pdf.describe()
    for c in "abc":
        for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                             ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
            assert abs(got[c][ours] - exp.loc[theirs, c]) < 1e-9, (c, ours)


def test_correlation_pairwise_complete(spark):
    pdf = _pdf()
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double")
    got = {(r["a"], r["b"]): r["r"] for r in profile.correlation(df).collect()}
    exp = pdf.corr()
    for x in "abc":
        for y in "abc":
            assert abs(got[(x, y)] - exp.loc[x, y]) < 1e-9


def test_correlation_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 2.0)], "x double, k double")
    got = {(r["a"], r["b"]): r["r"] for r in profile.correlation(df).collect()}
    assert got[("x", "k")] is None and abs(got[("x", "x")] - 1.0) < 1e-12


def test_missing_pct_and_info(spark):
    df = spark.createDataFrame([(1, None), (2, "x"), (3, None), (4, None)], "id long, s string")
    mp = {r["column"]: r["pct_missing"] for r in profile.missing_pct(df).collect()}
    assert mp == {"id": 0.0, "s": 75.0}
    info = {r["column"]: (r["non_null"], r["dtype"]) for r in profile.info(df).collect()}
    assert info == {"id": (4, "bigint"), "s": (1, "string")}
    assert profile.missing_pct_rounded(df, "s").first()[0] == 75.0


def test_duplicated_rows_counts(spark):
    data = [(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None), (3, "c")]
    df = spark.createDataFrame(data, "k int, v string")
    got = sorted(tuple(r) for r in profile.duplicated_rows(df).collect())
    assert got == [(1, "a"), (1, "a"), (2, None)]
    clean = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert profile.duplicated_rows(clean).count() == 0


def test_frequencies_order(spark):
    df = spark.createDataFrame([("x",), ("y",), ("y",), ("z",), ("x",), (None,)], "c string")
    got = [tuple(r) for r in profile.frequencies(df, "c").collect()]
    assert got == [("x", 2), ("y", 2), ("z", 1)]


def test_truncate_names_collision_raises():
    assert project.truncate_names(["channel_abc", "channel_xyz1"], 9) == ["channel_a", "channel_x"]
    try:
        project.truncate_names(["activity_nation_1", "activity_nation_2"], 12)
    except ValueError as e:
        assert "collide" in str(e)
    else:
        raise AssertionError("expected a collision error")


def test_duplicates_equal_a_plain_count_whatever_the_filter(spark):
    import random
    from collections import Counter
    rnd = random.Random(3)
    rows = [(rnd.choice([None, 1, 2, 3]), rnd.choice([None, "a", "b", ""]), rnd.choice([0.0, 1.5, None])) for _ in range(60)]
    rows += [(i, f"only {i}", float(i)) for i in range(10, 300)]
    df = spark.createDataFrame(rows, "_words long, b string, _h1 double")     # clashing names
    want = sorted((r for r, c in Counter(rows).items() for _ in range(c - 1)), key=str)
    for bits in (64, profile.FILTER_BITS):
        got = sorted((tuple(r) for r in profile.duplicated_rows(df, filter_bits=bits).collect()), key=str)
        assert got == want
    assert profile.duplicated_rows(df.limit(0)).count() == 0


def test_whole_rows_cross_no_exchange_before_the_filter(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(500).selectExpr("id", "cast(id % 400 as string) as name", "id * 2.0 as value").write.parquet(path)
    plan = profile.duplicated_rows(spark.read.parquet(path))._jdf.queryExecution().optimizedPlan().toString()
    # the whole rows are scanned, filtered by both bits, and only then grouped
    main = plan.split("scalar-subquery")[0]
    assert "Filter" in main and main.rindex("Aggregate") < main.rindex("Filter")
    assert main.count("Aggregate") == 1
