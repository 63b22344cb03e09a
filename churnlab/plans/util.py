"""Small helpers shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rnd(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (the oracle rounds the same columns the same way).

    Sums and means of doubles depend on summation order, which differs
    between engines and partitionings; comparing at a fixed number of
    decimals keeps the check about semantics, not about the last bit.
    """
    return df.select(*[F.round(F.col(n), digits).alias(n) if t in ("double", "float") else F.col(n)
                       for n, t in df.dtypes])


def f32(df: DataFrame, columns=None) -> DataFrame:
    """Cast double columns to 32-bit float for the oracle comparison.

    Used where a mean of short decimals can sit exactly on a decimal
    rounding boundary: a float32 cast has no such ties, and order-dependent
    noise (about 1e-13 relative) almost never crosses a float32 step.
    """
    cols = set(columns) if columns is not None else {n for n, t in df.dtypes if t == "double"}
    return df.select(*[F.col(n).cast("float").alias(n) if n in cols else F.col(n) for n in df.columns])
