"""Cleaning operators (CL1-CL10).

Statistics that feed a replacement (mode, median, mean, std, fences) are
one-row aggregates attached to every row by broadcast, so each operator is a
single lazy plan: no driver round trip, no per-column job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlab.operators import ordered
from churnlab.operators.joins import with_stats
from churnlab.operators.profile import medians

NULL_POLICIES = ("omit", "propagate")


def _one_row_from_long(long: DataFrame, key: str, value: str, columns: Sequence[str], suffix: str) -> DataFrame:
    wide = long.groupBy().pivot(key, list(columns)).agg(F.first(value))
    return wide.select(*[F.col(c).alias(f"{c}{suffix}") for c in columns])


def fill_with_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CL1: NULLs of each column replaced by the column's most frequent value (smallest on ties)."""
    m = ordered.modes(df, columns)
    stats = _one_row_from_long(m, "column", "mode", columns, "__mode")
    out = with_stats(df, stats)
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}__mode").cast(dict(df.dtypes)[c])) for c in columns})
    return out.drop(*[f"{c}__mode" for c in columns])


def fill_with_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CL2: NULLs of each column replaced by its exact median."""
    out = with_stats(df, medians(df, columns).select(*[F.col(c).alias(f"{c}__med") for c in columns]))
    out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"{c}__med")) for c in columns})
    return out.drop(*[f"{c}__med" for c in columns])


def negatives_to_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CL3: negative values replaced by the column median (median taken over all values, negatives included)."""
    out = with_stats(df, medians(df, columns).select(*[F.col(c).alias(f"{c}__med") for c in columns]))
    out = out.withColumns({c: F.when(F.col(c) < 0, F.col(f"{c}__med")).otherwise(F.col(c)) for c in columns})
    return out.drop(*[f"{c}__med" for c in columns])


def fill_and_fix_with_median(df: DataFrame, fill_columns: Sequence[str],
                             negative_columns: Sequence[str]) -> DataFrame:
    """CL2 then CL3 with one median pass.

    Filling the NULLs of a column with its median leaves the median
    unchanged: the n0 added copies sit exactly at the middle of the sorted
    values (odd count: on the middle element; even count: between the two
    middle ones), so the middle of the longer list is still that value.  The
    median CL3 takes over the filled column is therefore CL2's median, and
    both steps share one exact-median computation over the raw table.
    """
    cols = list(dict.fromkeys([*fill_columns, *negative_columns]))
    med = medians(df, cols).select(*[F.col(c).alias(f"{c}__med") for c in cols])
    out = with_stats(df, med)
    exprs = {}
    for c in cols:
        v = F.coalesce(F.col(c), F.col(f"{c}__med")) if c in fill_columns else F.col(c)
        exprs[c] = F.when(v < 0, F.col(f"{c}__med")).otherwise(v) if c in negative_columns else v
    return out.withColumns(exprs).drop(*[f"{c}__med" for c in cols])


def sparse_columns(df: DataFrame, max_missing_pct: float = 60.0) -> list[str]:
    """CL4 helper: columns whose NULL share exceeds ``max_missing_pct`` (one aggregation, one row to the driver)."""
    row = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if row[c] is not None and row[c] > max_missing_pct]


def drop_sparse(df: DataFrame, max_missing_pct: float | None = 60.0,
                columns: Sequence[str] | None = None) -> DataFrame:
    """CL4: drop an explicit list of columns, or those above a missing-value threshold."""
    cols = list(columns) if columns is not None else sparse_columns(df, max_missing_pct)
    return df.drop(*cols)


def negatives_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CL5: negative values become NULL."""
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in columns})


def replace_outliers_zscore(df: DataFrame, columns: Sequence[str], z: float = 3.0,
                            null_policy: str = "omit", report: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """CL6/CL7: z-score outlier and NULL replacement by the inlier mean, all columns at once.

    Per column (population statistics throughout):
      1. mean mu1 and std sd1 over the non-null values, z1 = (x - mu1) / sd1;
      2. m = mean of the values with -z < z1 < z;
      3. NULLs := m;
      4. mean / std again over the filled column, z2;
      5. values with |z2| > z := m.
    Step 4 needs no pass: the filled column is the old values plus n0 copies
    of m, so its mean and variance follow from (n1, mu1, sd1, m, n0) by the
    parallel-variance formula.  Two aggregations in total, whatever the
    number of columns.

    ``null_policy='omit'`` ignores NULLs in the statistics (the stated intent).
    ``'propagate'`` reproduces SciPy's default: a column holding any NULL is
    left unchanged (its statistics would all be NaN).

    Returns (cleaned frame, report with per-column n_null, n_outlier, inlier_mean);
    the report is None with ``report=False``.
    """
    if null_policy not in NULL_POLICIES:
        raise ValueError(f"null_policy must be one of {NULL_POLICIES}")
    cols = list(columns)
    s1 = df.agg(*[a for i, c in enumerate(cols) for a in (
        F.count(c).alias(f"_n1_{i}"), F.count(F.lit(1)).alias(f"_N_{i}"),
        F.avg(c).alias(f"_mu1_{i}"), F.stddev_pop(c).alias(f"_sd1_{i}"))])
    with1 = with_stats(df.select(*cols), s1)

    def z1(i, c) -> Column:
        return F.try_divide(F.col(c) - F.col(f"_mu1_{i}"), F.col(f"_sd1_{i}"))

    s2 = with1.agg(*[F.avg(F.when(F.abs(z1(i, c)) < z, F.col(c))).alias(f"_m_{i}") for i, c in enumerate(cols)])
    s12 = with_stats(s1, s2)  # both one row

    stats = []
    for i, _ in enumerate(cols):
        n1, N = F.col(f"_n1_{i}"), F.col(f"_N_{i}")
        mu1, sd1, m = F.col(f"_mu1_{i}"), F.col(f"_sd1_{i}"), F.col(f"_m_{i}")
        n0 = N - n1
        filled_n = F.when(m.isNull(), n1).otherwise(N)
        mu2 = F.when(m.isNull(), mu1).otherwise(F.try_divide(n1 * mu1 + n0 * m, N))
        m2 = sd1 * sd1 * n1 + F.when(m.isNull(), F.lit(0.0)).otherwise(
            (m - mu1) * (m - mu1) * n1 * n0 / N)
        sd2 = F.sqrt(F.try_divide(m2, filled_n))
        untouched = F.lit(null_policy == "propagate") & (n0 > 0)
        stats += [mu2.alias(f"_mu2_{i}"), sd2.alias(f"_sd2_{i}"), untouched.alias(f"_keep_{i}")]
    s = s12.select("*", *stats)

    out = with_stats(df, s)
    new = {}
    for i, c in enumerate(cols):
        m = F.col(f"_m_{i}")
        filled = F.coalesce(F.col(c), m)
        z2 = F.try_divide(filled - F.col(f"_mu2_{i}"), F.col(f"_sd2_{i}"))
        cleaned = F.when(F.abs(z2) > z, m).otherwise(filled)
        new[c] = F.when(F.col(f"_keep_{i}"), F.col(c)).otherwise(cleaned)
    helper = [f"_{k}_{i}" for i in range(len(cols)) for k in ("n1", "N", "mu1", "sd1", "m", "mu2", "sd2", "keep")]
    cleaned_df = out.withColumns(new).drop(*helper)
    if not report:
        return cleaned_df, None

    # report: the reference prints the NULL count (CL7) or the outlier count (CL6); both are given
    rep_src = with_stats(df.select(*cols), s)
    rep = rep_src.agg(*[a for i, c in enumerate(cols) for a in (
        F.count_if(F.col(c).isNull()).alias(f"_nn_{i}"),
        F.count_if(~F.col(f"_keep_{i}") & (F.abs(F.try_divide(F.coalesce(F.col(c), F.col(f"_m_{i}")) - F.col(f"_mu2_{i}"),
                                                             F.col(f"_sd2_{i}"))) > z)).alias(f"_no_{i}"),
        F.first(F.col(f"_m_{i}")).alias(f"_im_{i}"))])
    structs = [F.struct(F.lit(c).alias("column"), F.col(f"_nn_{i}").alias("n_null"),
                        F.col(f"_no_{i}").alias("n_outlier"), F.col(f"_im_{i}").alias("inlier_mean"))
               for i, c in enumerate(cols)]
    return cleaned_df, rep.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def iqr_fences(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """CL8: one row (iqr, lower_bound, upper_bound) from exact linear quartiles."""
    q = ordered.exact_quantiles(df, [column], [0.25, 0.75], ["q1", "q3"])
    return q.select((F.col("q3") - F.col("q1")).alias("iqr"),
                    (F.col("q1") - F.lit(k) * (F.col("q3") - F.col("q1"))).alias("lower_bound"),
                    (F.col("q3") + F.lit(k) * (F.col("q3") - F.col("q1"))).alias("upper_bound"))


def remove_outliers_iqr(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """CL9 (intent): keep rows whose value lies within the IQR fences (inclusive)."""
    f = iqr_fences(df, column, k).select("lower_bound", "upper_bound")
    c = F.col(column)
    return (with_stats(df, f).where((c >= F.col("lower_bound")) & (c <= F.col("upper_bound")))
                             .drop("lower_bound", "upper_bound"))


def remove_outliers_zscore(df: DataFrame, column: str, z: float = 3.0) -> DataFrame:
    """CL10 (intent): keep rows with -z < zscore < z (population std)."""
    from churnlab.functions.scalar import zscore_frame
    return zscore_frame(df, column, "_z").where(F.abs(F.col("_z")) < z).drop("_z")
