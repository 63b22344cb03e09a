"""Churn rates by dimension (AG1-AG8, AG11, AG12) and ordered reports (SO1, SO2).

All crosstabs are single conditional aggregations: one hash aggregate with a
map-side partial step and one shuffle on the group key.  (``pivot`` would add
a second aggregation over (key, class) first.)  pandas semantics kept:

* rows whose group key is NULL are dropped (pandas ``groupby`` drops them);
* a cell with no rows of that class is NULL (``unstack``), zero only with
  ``fill_zero`` (``fillna(0)``);
* a row total skips NULL cells, a percentage of a NULL cell stays NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlab.functions.dates import as_date
from churnlab.operators.joins import with_stats

CLASSES = (0, 1)


def class_col(v) -> str:
    return f"class_{v}"


def pct_col(v) -> str:
    return f"pct_{v}"


def count_by(df: DataFrame, key: str, count_col: str = "id", name: str = "n") -> DataFrame:
    """AG1: rows per key (non-null ``count_col`` values, as pandas ``count``)."""
    return (df.where(F.col(key).isNotNull())
              .groupBy(key).agg(F.count(count_col).alias(name)))


def share_pct(counts: DataFrame, count_col: str = "n", name: str = "pct", digits: int = 1) -> DataFrame:
    """AG2: each group's share of the total in percent, rounded half-to-even.

    The total is a one-row aggregate attached by broadcast, not a window over
    the whole table (which would run in a single task).
    """
    total = counts.agg(F.sum(count_col).alias("_total"))
    return (with_stats(counts, total)
            .withColumn(name, F.bround(F.try_divide(F.col(count_col), F.col("_total")) * 100, digits))
            .drop("_total"))


def _cell(label: Column, v, count_col: str) -> Column:
    # NULL when the group has no row of class v (pandas unstack), else count of ids
    return F.when(F.count_if(label == F.lit(v)) > 0, F.count(F.when(label == F.lit(v), F.col(count_col))))


def crosstab(df: DataFrame, key: str | Sequence[str], label: str = "churn", count_col: str = "id",
             classes: Sequence = CLASSES, fill_zero: bool = False) -> DataFrame:
    """AG3/AG4: count of ``count_col`` per key x class, one column per class."""
    keys = [key] if isinstance(key, str) else list(key)
    lab = F.col(label)
    src = df
    for k in keys:
        src = src.where(F.col(k).isNotNull())
    cells = [_cell(lab, v, count_col).alias(class_col(v)) for v in classes]
    out = src.groupBy(*keys).agg(*cells)
    if fill_zero:
        out = out.na.fill(0, [class_col(v) for v in classes])
    return out


def row_percent(ct: DataFrame, classes: Sequence = CLASSES, keep_counts: bool = False) -> DataFrame:
    """AG5: row-normalised crosstab in percent; NULL cells stay NULL, the total skips them."""
    total = sum((F.coalesce(F.col(class_col(v)), F.lit(0)) for v in classes), F.lit(0))
    pcts = {pct_col(v): F.try_divide(F.col(class_col(v)), total) * 100 for v in classes}
    out = ct.withColumns(pcts)
    if not keep_counts:
        out = out.drop(*[class_col(v) for v in classes])
    return out


def churn_rate(df: DataFrame, key: str, label: str = "churn", count_col: str = "id",
               rate_name: str = "churn_pct", total_name: str = "n_companies") -> DataFrame:
    """AG6: churn percentage and company total per category (zero-filled crosstab)."""
    lab = F.col(label)
    n1 = F.count(F.when(lab == 1, F.col(count_col)))
    n = F.count(F.when(lab.isin(*CLASSES), F.col(count_col)))
    return (df.where(F.col(key).isNotNull())
              .groupBy(key)
              .agg(n.alias(total_name), n1.alias("_n1"))
              .withColumn(rate_name, F.try_divide(F.col("_n1"), F.col(total_name)) * 100)
              .select(key, rate_name, total_name))


def monthly_crosstab(df: DataFrame, date_col: str, label: str = "churn", count_col: str = "id",
                     classes: Sequence = CLASSES, month_name: str = "month_end") -> DataFrame:
    """AG7: counts per calendar month (labelled by its last day) x class; NULL dates drop.

    pandas' ``Grouper(freq='M')`` emits every month between the first and last
    one, with NULL cells for empty months; the month spine is generated from
    the min/max of the crosstab's months and left-joined, so no month is missing.
    Text that is no date counts as NULL.
    """
    d = as_date(df, date_col)
    keyed = df.where(d.isNotNull()).withColumn(month_name, F.last_day(d))
    ct = crosstab(keyed, month_name, label, count_col, classes)
    first = F.trunc(F.col(month_name), "month")
    bounds = ct.agg(F.min(first).alias("_lo"), F.max(first).alias("_hi"))
    spine = bounds.select(F.explode(F.sequence(F.col("_lo"), F.col("_hi"), F.expr("INTERVAL 1 MONTH")))
                          .alias("_m")).select(F.last_day("_m").alias(month_name))
    return spine.join(ct, month_name, "left")


def group_means(df: DataFrame, key: str | Sequence[str], columns: Sequence[str] | None = None,
                prefix: str = "", suffix: str = "") -> DataFrame:
    """AG8: mean of every numeric column per key (NULLs skipped, as pandas)."""
    keys = [key] if isinstance(key, str) else list(key)
    if columns is None:
        columns = numeric_columns(df, exclude=keys)
    return df.groupBy(*keys).agg(*[F.avg(c).alias(f"{prefix}{c}{suffix}") for c in columns])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    numeric = ("int", "bigint", "smallint", "tinyint", "double", "float")
    return [n for n, t in df.dtypes if t in numeric or t.startswith("decimal") if n not in exclude]


def inlier_mean(df: DataFrame, col: str, z: float = 3.0) -> DataFrame:
    """AG11: mean of the values whose population z-score lies strictly inside (-z, z)."""
    c = F.col(col)
    stats = df.agg(F.avg(c).alias("_mu"), F.stddev_pop(c).alias("_sd"))
    zc = F.try_divide(c - F.col("_mu"), F.col("_sd"))
    return with_stats(df.select(col), stats).agg(
        F.avg(F.when(F.abs(zc) < z, c)).alias(f"{col}_inlier_mean"))


def null_and_outlier_counts(df: DataFrame, col: str, z: float = 3.0) -> DataFrame:
    """AG12: NULL count and |z| > z count of one column, in one pass after the stats."""
    c = F.col(col)
    stats = df.agg(F.avg(c).alias("_mu"), F.stddev_pop(c).alias("_sd"))
    zc = F.try_divide(c - F.col("_mu"), F.col("_sd"))
    return with_stats(df.select(col), stats).agg(
        F.count_if(c.isNull()).alias("n_null"),
        F.count_if(F.abs(zc) > z).alias("n_outlier"))


def sort_by_class(df: DataFrame, key: str | Sequence[str], by: str = pct_col(1)) -> DataFrame:
    """SO1: descending by one class column, NULLs last, key as tie-break."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(F.col(by).desc_nulls_last(), *[F.col(k).asc() for k in keys])


def top_k(df: DataFrame, by: str, key: str | Sequence[str], k: int) -> DataFrame:
    """SO2: top-k rows by ``by`` descending (distributed TakeOrderedAndProject)."""
    return sort_by_class(df, key, by).limit(k)
