"""Date functions (SF1-SF4) as Column expressions.

pandas divides a timedelta by ``np.timedelta64(1, 'Y')`` / ``('M')``, i.e.
by 365.2425 / 30.436875 days, and ``astype(int)`` truncates toward zero.
The same is expressed with ``datediff`` and a cast (Spark's double-to-int
cast truncates).  Calendar functions such as ``months_between`` give other
numbers and are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

# numpy's mean Gregorian year and month, in days.
DAYS_PER_YEAR = 365.2425
DAYS_PER_MONTH = 30.436875


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c, fmt: str = "yyyy-MM-dd", strict: bool = False) -> Column:
    """SF1: text to DATE.  Lenient by default (bad text -> NULL); ``strict`` raises like pandas."""
    return F.to_date(_c(c), fmt) if strict else F.try_to_date(_c(c), fmt)


def as_date(df: DataFrame, column: str, fmt: str = "yyyy-MM-dd") -> Column:
    """A DATE column as it is, a text column parsed (bad text -> NULL)."""
    if isinstance(df.schema[column].dataType, (DateType, TimestampType, TimestampNTZType)):
        return F.col(column).cast("date")
    return parse_date(F.col(column).cast("string"), fmt)


def whole_years(end, start) -> Column:
    """SF2: whole years from ``start`` to ``end`` (truncated toward zero)."""
    return (F.datediff(_c(end), _c(start)) / F.lit(DAYS_PER_YEAR)).cast("int")


def whole_months(ref, c) -> Column:
    """SF3: whole months from ``c`` to ``ref`` (truncated toward zero; negative if c is later)."""
    return (F.datediff(_c(ref), _c(c)) / F.lit(DAYS_PER_MONTH)).cast("int")


def month_tick_label(d) -> Column:
    """SF4: first letter of the month name, plus a newline and the year for January."""
    d = _c(d)
    return F.concat(F.substring(F.date_format(d, "MMMM"), 1, 1),
                    F.when(F.month(d) == 1, F.concat(F.lit("\n"), F.year(d).cast("string"))).otherwise(F.lit("")))
