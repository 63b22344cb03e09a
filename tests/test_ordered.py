import random

import numpy as np
from pyspark.sql import functions as F

from churnlab.operators import ordered


def test_prefix_sums_match_python_with_hot_group(spark):
    rnd = random.Random(7)
    data = [(0 if rnd.random() < 0.7 else rnd.randint(1, 3), i, rnd.randint(0, 5)) for i in range(3000)]
    df = spark.createDataFrame(data, "g int, o int, v long")
    out = ordered.prefix_sums(df, ["g"], [F.col("o")], ["v"], partitions=7)
    got = {(r["g"], r["o"]): r["cum_v"] for r in out.collect()}
    run = {}
    for g, o, v in sorted(data, key=lambda t: (t[0], t[1])):
        run[g] = run.get(g, 0) + v
        assert got[(g, o)] == run[g]


def test_prefix_sums_descending_no_group(spark):
    df = spark.createDataFrame([(float(i),) for i in range(100)], "s double").withColumn("one", F.lit(1))
    out = ordered.prefix_sums(df, [], [F.col("s").desc()], ["one"], partitions=5)
    got = {r["s"]: r["cum_one"] for r in out.collect()}
    assert got[99.0] == 1 and got[0.0] == 100


def test_row_numbers(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(50)], "g int, k int")
    out = ordered.row_numbers(df, ["g"], [F.col("k").desc()], "rn", partitions=3)
    got = {(r["g"], r["k"]): r["rn"] for r in out.collect()}
    assert got[(0, 48)] == 1 and got[(1, 1)] == 25


def test_exact_quantiles_match_numpy(spark):
    rnd = random.Random(3)
    xs = [round(rnd.gauss(0, 10), 2) for _ in range(501)] + [5.0] * 40
    ys = [float(v) for v in range(10)]
    df = spark.createDataFrame([(x, ys[i] if i < len(ys) else None) for i, x in enumerate(xs)], "x double, y double")
    q = {r["column"]: r for r in ordered.exact_quantiles(df, ["x", "y"], [0.25, 0.5, 0.75, 0.9]).collect()}
    for c, vals in (("x", xs), ("y", ys)):
        exp = np.percentile(vals, [25, 50, 75, 90])
        got = [q[c]["q25"], q[c]["q50"], q[c]["q75"], q[c]["q90"]]
        assert np.allclose(got, exp, rtol=0, atol=1e-9), (c, got, exp)


def test_quantiles_of_empty_column_are_null(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    q = {r["column"]: r["q50"] for r in ordered.exact_quantiles(df, ["x", "y"], [0.5]).collect()}
    assert q == {"x": 1.5, "y": None}


def test_modes_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,), (None,), (None,)], "d string")
    m = ordered.modes(df, ["d"]).first()
    assert (m["mode"], m["cnt"]) == ("a", 2)


def test_folds_keep_null_labels_and_do_not_depend_on_arrival(spark):
    from churnlab.operators import splits
    rows = [(i % 40, None if i % 7 == 0 else i % 2, float(i % 13)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, churn int, x double")
    seen = [sorted(map(tuple, splits.stratified_folds(df.repartition(n), "churn", ["id"], 3).collect()), key=str) for n in (1, 7)]
    assert len(seen[0]) == 300 and seen[0] == seen[1]
    null_ids = spark.createDataFrame([(None, 1), (1, 0), (2, 1)], "id long, churn int")
    assert splits.stratified_folds(null_ids, "churn", ["id"], 2, unique_keys=True).count() == 3
    assert splits.grouped_stratified_folds(null_ids, "churn", "id", 2).count() == 3


def test_quantiles_through_narrowed_brackets(spark, monkeypatch):
    """Near-unique, heavily tied, constant and empty columns, with brackets narrowed again and again."""
    from churnlab.operators import ordered
    monkeypatch.setattr(ordered, "BRACKET_VALUES", 50)
    monkeypatch.setattr(ordered, "SKETCH", 100)
    rnd = random.Random(3)
    rows = [(rnd.gauss(0, 1), float(rnd.randint(0, 3)), 7.0, None, None if i % 3 else rnd.random()) for i in range(4000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["column"]: list(r)[1:] for r in ordered.exact_quantiles(df, list("abcde"), probs).collect()}
    for i, c in enumerate("abcde"):
        v = [r[i] for r in rows if r[i] is not None]
        assert got[c] == ([None] * 6 if not v else [float(np.quantile(v, p)) for p in probs]) or np.allclose(got[c], np.quantile(v, probs), rtol=1e-12)


def test_modes_of_wide_domains_ties_and_nulls(spark):
    n = 100_000
    x = F.col("id")
    df = spark.range(n, numPartitions=6).select(
        x.alias("unique"), F.when(x % 50 == 0, "b").when(x % 50 == 1, "a").otherwise(F.concat(F.lit("v"), x)).alias("tie"),
        F.when(x % 1000 == 7, x % 3).when(x % 2 == 0, x).alias("weak"), F.lit(None).cast("long").alias("none"),
        (x % 100).alias("flat"))
    counts, undecided = ordered.frequent_counts(df, ["unique", "tie", "weak", "none", "flat"])
    assert undecided == ["unique", "flat"]
    assert counts["tie"]["a"] == counts["tie"]["b"] == n // 50
    got = {r["column"]: (r["mode"], r["cnt"]) for r in ordered.modes(df, ["unique", "tie", "weak", "none", "flat"]).collect()}
    assert got["unique"] == ("0", 1) and got["tie"] == ("a", n // 50) and "none" not in got
    most = {k: sum(1 for i in range(7, n, 1000) if i % 3 == k) + (k % 2 == 0) for k in range(3)}
    assert got["weak"][1] == max(most.values())
    assert got["flat"] == ("0", n // 100)       # more ties than candidates
    assert ordered.modes(df.limit(0), ["tie"]).collect() == []
