"""Filters and predicates (FI1-FI5); all are plain ``where`` clauses that
Catalyst pushes into the parquet scan when they touch scanned columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlab.functions.dates import as_date


def equals(df: DataFrame, column: str, value) -> DataFrame:
    """FI1: rows where ``column == value``."""
    return df.where(F.col(column) == F.lit(value))


def any_negative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """FI2: rows where at least one of ``columns`` is below zero."""
    cond: Column = F.lit(False)
    for c in columns:
        cond = cond | (F.col(c) < 0)
    return df.where(cond)


def after_date(df: DataFrame, column: str, day: str) -> DataFrame:
    """FI3: strict lower bound 'yyyy-MM-dd' on a DATE column (pushed into the scan) or a text column
    (text that is no date drops)."""
    return df.where(as_date(df, column) > F.lit(day).cast("date"))


def drop_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """FI4: drop rows with a NULL in any of ``columns``."""
    return df.na.drop(subset=list(columns))


def inside_band(df: DataFrame, score: str, z: float = 3.0) -> DataFrame:
    """FI5: rows with -z < score < z (exactly z is in neither band)."""
    return df.where(F.abs(F.col(score)) < z)


def outside_band(df: DataFrame, score: str, z: float = 3.0) -> DataFrame:
    """FI5: rows with score < -z or score > z."""
    return df.where(F.abs(F.col(score)) > z)
