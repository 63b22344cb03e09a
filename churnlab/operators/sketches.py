"""Stored quantile sketches: IN5 / AG9 / AG13 over a history that grows month by month.

A KLL sketch per (part, column) is kept beside the history.  A new month adds
its own sketches; quantiles of any set of months come from merged sketches, so
old rows are never read again.  Sketches merge in any order, and the merged one
has the error of one built at once: a quantile's true rank differs from the
asked one by at most ``rank_error(k)`` of the rows with 99 % confidence (the
published bound of the sketch).  Counts are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlab.operators.ordered import to_long

K = 2_000


def rank_error(k: int = K) -> float:
    """Share of the rows by which a quantile's rank may be off."""
    return 2.296 / k ** 0.9723


def build(df: DataFrame, columns: Sequence[str], part: Column, k: int = K) -> DataFrame:
    """(part, column, n, sketch): one sketch per part and column over its non-null values.

    Partial sketches are built in every task, so a part that holds most rows
    sends a few kilobytes a task.  A null part is a part of its own; a column
    without values in a part has no row there.
    """
    long = to_long(df.withColumn("_part", part), columns, ids=["_part"]).where(F.col("value").isNotNull() & ~F.isnan("value"))
    return (long.groupBy(F.col("_part").alias("part"), "column")
            .agg(F.count("*").alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch")))


def merge(sketches: DataFrame, by: Sequence[str] = ("column",)) -> DataFrame:
    """(by..., n, sketch): the sketches of each group as one."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, probs: Sequence[float], names: Sequence[str] | None = None) -> DataFrame:
    """The other columns, ``n`` and a column per probability."""
    names = list(names or [f"q{int(round(p * 100)):02d}" for p in probs])
    rest = [c for c in sketches.columns if c not in ("sketch",)]
    return sketches.select(*rest, *(F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(nm)
                                    for p, nm in zip(probs, names, strict=True)))


def describe(sketches: DataFrame) -> DataFrame:
    """Per column: n and quartiles of all parts together."""
    return quantiles(merge(sketches), [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
