"""Projections (PR1-PR6)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def subset(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PR1: column subset (Catalyst prunes the scan to these columns)."""
    return df.select(*columns)


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PR2: rename columns; unknown names are ignored, as pandas does."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PR3: drop columns."""
    return df.drop(*columns)


def add_pair_sums(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """PR4: new columns as the row-wise sum of two columns (NULL if either is NULL, as pandas)."""
    return df.withColumns({out: F.col(a) + F.col(b) for out, (a, b) in pairs.items()})


def truncate_names(names: Sequence[str], width: int) -> list[str]:
    """PR5: cut column names to ``width`` characters; raise when two names collide.

    pandas would silently keep duplicate names; a Spark column reference
    would then be ambiguous, so a collision is an error here.
    """
    out = [n[:width] for n in names]
    seen: dict[str, str] = {}
    for full, cut in zip(names, out):
        if cut in seen:
            raise ValueError(f"truncating to {width} characters makes {seen[cut]!r} and {full!r} collide as {cut!r}")
        seen[cut] = full
    return out


def truncate_columns(df: DataFrame, width: int, columns: Sequence[str] | None = None) -> DataFrame:
    """PR5 on a frame: truncate the names of ``columns`` (default all)."""
    cols = list(columns) if columns is not None else df.columns
    cut = dict(zip(cols, truncate_names(cols, width)))
    return df.withColumnsRenamed({k: v for k, v in cut.items() if k != v})


def transpose_by_class(summary: DataFrame, label: str = "churn", value: str = "n",
                       classes: Sequence = (0, 1), name: str = "measure") -> DataFrame:
    """PR6: turn a (class, value) summary into one row with a column per class.

    The summary has one row per class (a handful), so this is a tiny
    global aggregate.
    """
    lab = F.col(label)
    return summary.agg(*[F.first(F.when(lab == v, F.col(value)), ignorenulls=True).alias(f"class_{v}")
                         for v in classes]).select(F.lit(value).alias(name), "*")
