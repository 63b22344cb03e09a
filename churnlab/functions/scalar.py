"""Scalar column functions (SF5-SF12, SF14).

All are built-in expressions (JVM side, whole-stage codegen); statistics
they need (mean, population std) come from a one-row aggregate attached by
broadcast, so the plan stays lazy and distributed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlab.operators.joins import with_stats


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log10p1(c) -> Column:
    """SF5: log10(x + 1); NULL for x <= -1 (pandas: NaN / -inf)."""
    x = _c(c) + F.lit(1.0)
    return F.when(x > 0, F.log10(x))


def map_values(c, mapping: Mapping, otherwise=None) -> Column:
    """SF6: value map, e.g. {'t': 1, 'f': 0}; unmapped values become ``otherwise`` (NULL)."""
    expr = None
    for k, v in mapping.items():
        expr = (F.when(_c(c) == F.lit(k), F.lit(v)) if expr is None
                else expr.when(_c(c) == F.lit(k), F.lit(v)))
    return expr.otherwise(F.lit(otherwise)) if otherwise is not None else expr


def replace_values(c, values: Sequence, replacement) -> Column:
    """SF7: replace a short, fixed list of values by one value (long lists: see features.fold_rare)."""
    return F.when(_c(c).isin(*values), F.lit(replacement)).otherwise(_c(c))


def fill(c, value) -> Column:
    """SF8: NULL to a constant."""
    return F.coalesce(_c(c), F.lit(value))


def negate(c) -> Column:
    """SF9: unary minus."""
    return -_c(c)


def round_half_even(c, digits: int = 0) -> Column:
    """SF10: half-to-even rounding (pandas / numpy ``round``)."""
    return F.bround(_c(c), digits)


def zscore_frame(df: DataFrame, col: str, out: str = "zscore") -> DataFrame:
    """SF11: population z-score of ``col`` on every row (NULL when std is 0 or value NULL)."""
    stats = df.agg(F.avg(col).alias("_zmu"), F.stddev_pop(col).alias("_zsd"))
    return (with_stats(df, stats)
            .withColumn(out, F.try_divide(F.col(col) - F.col("_zmu"), F.col("_zsd")))
            .drop("_zmu", "_zsd"))


def clamp(c, lo: float = 0.0, hi: float = 1.0) -> Column:
    """SF12: clamp into [lo, hi]; NULL stays NULL (``greatest``/``least`` alone would skip it)."""
    return F.when(_c(c).isNotNull(), F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi)))


def bar_label(c, digits: int = 1) -> Column:
    """SF14: bar annotation text: value rounded to one decimal; NULL where it reads '0.0'."""
    txt = F.format_string(f"%.{digits}f", F.bround(_c(c), digits))
    return F.when(_c(c).isNotNull() & (txt != F.lit("0." + "0" * digits)), txt)
