"""Quantile sketches stored by part: counts, rank errors, merging, odd values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlab.operators import sketches


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    x = rng.lognormal(0, 2, 40_000)
    pdf = [(int(i % 5), float(v), None if i % 3 else float(i % 11)) for i, v in enumerate(x)]
    return spark.createDataFrame(pdf, "month int, x double, y double").cache()


def rank_gap(values, q, p):
    """How far p lies from the ranks that q covers, as a share of the values."""
    v = np.asarray(values)
    low, high = (v < q).mean(), (v <= q).mean()
    return max(low - p, p - high, 0.0)


@pytest.mark.parametrize("k", [200, 2000])
def test_merged_and_built_at_once_stay_within_the_bound(table, k):
    values = {c: [r[c] for r in table.select(c).collect() if r[c] is not None] for c in ("x", "y")}
    parts = sketches.build(table, ["x", "y"], F.col("month"), k)
    assert parts.count() == 10
    once = sketches.build(table, ["x", "y"], F.lit(0), k)
    for s in (sketches.merge(parts), once.drop("part")):
        for r in sketches.quantiles(s, [0.05, 0.25, 0.5, 0.9]).collect():
            assert r.n == len(values[r["column"]])
            for p, name in ((0.05, "q05"), (0.25, "q25"), (0.5, "q50"), (0.9, "q90")):
                assert rank_gap(values[r["column"]], r[name], p) <= sketches.rank_error(k)


def test_a_new_month_needs_no_old_rows(spark, table):
    old = sketches.build(table.where("month < 4"), ["x"], F.col("month"))
    new = sketches.build(table.where("month = 4"), ["x"], F.col("month"))
    r = sketches.describe(old.unionByName(new)).first()
    v = [x.x for x in table.select("x").collect()]
    assert r.n == len(v) and all(rank_gap(v, r[c], p) <= sketches.rank_error() for c, p in (("p25", .25), ("p50", .5), ("p75", .75)))


def test_odd_values(spark):
    df = spark.createDataFrame([(None, 1.0), (1, None), (1, float("nan")), (2, 3.0), (2, 3.0)], "part int, x double")
    got = {r.part: r.n for r in sketches.build(df, ["x"], F.col("part")).collect()}
    assert got == {None: 1, 2: 2}
    assert sketches.describe(sketches.build(df.where("false"), ["x"], F.col("part"))).count() == 0
