"""The numbers behind each chart (CH1-CH5); drawing is left to the caller.

Every chart table is small (bins x classes, grid points, categories), but
is computed from the whole column with distributed aggregations.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.functions.scalar import bar_label
from churnlab.operators import ordered, rates
from churnlab.operators.joins import with_stats
from churnlab.operators.profile import correlation


def histogram_by_class(df: DataFrame, column: str, label: str = "churn", bins: int = 50,
                       classes: Sequence = rates.CLASSES) -> DataFrame:
    """CH1: counts per class in ``bins`` equal-width bins shared by all classes.

    Edges are ``lo + k * (hi - lo) / bins`` (last edge = hi, included in the
    last bin), like numpy; a constant column gets the range [v - 0.5, v + 0.5].
    Output: (bin, bin_start, bin_end, class_0, class_1), every bin present.
    """
    x = F.col(column)
    vals = df.where(x.isNotNull()).select(column, label)
    b = vals.agg(F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    b = b.select(F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_lo"),
                 F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_hi"))
    b = b.withColumn("_step", (F.col("_hi") - F.col("_lo")) / F.lit(bins))
    lo, hi, step = F.col("_lo"), F.col("_hi"), F.col("_step")

    def edge(k):
        return F.when(k >= bins, hi).otherwise(lo + k * step)

    idx0 = F.least(F.greatest(F.floor((x - lo) / (hi - lo) * F.lit(bins)), F.lit(0)), F.lit(bins - 1))
    j = with_stats(vals, b).withColumn("_i0", idx0.cast("int"))
    i0 = F.col("_i0")
    idx = (i0 - F.when(x < edge(i0), 1).otherwise(0)
           + F.when((x >= edge(i0 + 1)) & (i0 != bins - 1), 1).otherwise(0))
    lab = F.col(label)
    counts = (j.withColumn("bin", idx).groupBy("bin")
                .agg(*[F.count_if(lab == F.lit(v)).alias(rates.class_col(v)) for v in classes]))
    spine = b.select(F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), "_lo", "_hi", "_step")
    spine = spine.select("bin", edge(F.col("bin")).alias("bin_start"), edge(F.col("bin") + 1).alias("bin_end"))
    out = spine.join(counts, "bin", "left")
    return out.na.fill(0, [rates.class_col(v) for v in classes])


def box_stats(df: DataFrame, column: str, whis: float = 1.5) -> DataFrame:
    """CH2: q1, median, q3, iqr, whiskers (furthest values within whis * iqr) and outlier count."""
    q = ordered.exact_quantiles(df, [column], [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    q = q.select("q1", "median", "q3", (F.col("q3") - F.col("q1")).alias("iqr"))
    x = F.col(column)
    lo_f = F.col("q1") - F.lit(whis) * F.col("iqr")
    hi_f = F.col("q3") + F.lit(whis) * F.col("iqr")
    j = with_stats(df.select(column).where(x.isNotNull()), q)
    return j.groupBy("q1", "median", "q3", "iqr").agg(
        F.count(x).alias("n"),
        F.min(F.when(x >= lo_f, x)).alias("whisker_low"),
        F.max(F.when(x <= hi_f, x)).alias("whisker_high"),
        F.count_if((x < lo_f) | (x > hi_f)).alias("n_outliers"))


def density(df: DataFrame, column: str, gridsize: int = 100, cut: float = 3.0,
            bw_method: str = "scott") -> DataFrame:
    """CH3: Gaussian kernel density of a column on an evenly spaced grid.

    Bandwidth = std (sample) * factor, factor n^(-1/5) (Scott) or
    (n * 3/4)^(-1/5) (Silverman); grid from min - cut*bw to max + cut*bw.
    Each value contributes to the grid points within 39 bandwidths, emitted
    with ``explode`` and summed per grid point with map-side combine; beyond,
    exp(-u*u/2) is exactly 0 in double arithmetic, so no term is lost.  A
    constant (or single-row) column has no bandwidth: its density is NULL.
    """
    reach = 39.0
    x = F.col(column)
    vals = df.where(x.isNotNull()).select(column)
    n, sd = F.col("_n"), F.col("_sd")
    factor = F.pow(n, F.lit(-0.2)) if bw_method == "scott" else F.pow(n * 0.75, F.lit(-0.2))
    s = vals.agg(F.count(x).alias("_n"), F.stddev_samp(x).alias("_sd"), F.min(x).alias("_mn"), F.max(x).alias("_mx"))
    s = s.withColumn("_bw", sd * factor)
    s = s.withColumn("_glo", F.col("_mn") - F.lit(cut) * F.col("_bw")) \
         .withColumn("_ghi", F.col("_mx") + F.lit(cut) * F.col("_bw")) \
         .withColumn("_gstep", (F.col("_ghi") - F.col("_glo")) / F.lit(gridsize - 1))
    glo, gstep, bw = F.col("_glo"), F.col("_gstep"), F.col("_bw")
    kmin = F.greatest(F.ceil(F.try_divide(x - F.lit(reach) * bw - glo, gstep)), F.lit(0)).cast("int")
    kmax = F.least(F.floor(F.try_divide(x + F.lit(reach) * bw - glo, gstep)), F.lit(gridsize - 1)).cast("int")
    j = with_stats(vals, s).where(bw > 0)
    j = j.withColumn("k", F.explode(F.sequence(kmin, F.greatest(kmin, kmax)))).where(F.col("k") <= kmax)
    u = F.try_divide(glo + F.col("k") * gstep - x, bw)
    contrib = j.groupBy("k").agg(F.sum(F.exp(-0.5 * u * u)).alias("_ksum"))
    norm = F.lit(1.0 / math.sqrt(2.0 * math.pi))
    spine = s.select(F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("k"), "_glo", "_gstep", "_n", "_bw")
    out = spine.join(contrib, "k", "left")
    return out.select("k", (F.col("_glo") + F.col("k") * F.col("_gstep")).alias("x"),
                      F.try_divide(F.coalesce(F.col("_ksum"), F.lit(0.0)) * norm, F.col("_n") * F.col("_bw")).alias("density"))


def density_binned(df: DataFrame, column: str, gridsize: int = 100, bins: int = 2_000, cut: float = 3.0,
                   bw_method: str = "scott") -> DataFrame:
    """CH3 for very many rows: (k, x, density, error); the exact density lies within ``error`` of ``density``.

    Linear binning: every value splits its weight between the two nearest of
    ``bins`` + 1 nodes from min to max, one aggregation of at most two rows a
    value into ``bins`` + 1 rows; the kernel is then summed over nodes, not
    values.  Replacing the kernel by its chords of width d errs by at most
    d^2 / 8 times its largest second derivative, d^2 / (8 sqrt(2 pi) bw^3).
    Bandwidth and grid as in :func:`density`; NaN if any value is NaN.
    """
    x = F.col(column).cast("double")
    vals = df.where(x.isNotNull()).select(x.alias("_x"))
    factor = F.pow(F.col("_n"), F.lit(-0.2)) if bw_method == "scott" else F.pow(F.col("_n") * 0.75, F.lit(-0.2))
    s = vals.agg(F.count("_x").alias("_n"), F.stddev_samp("_x").alias("_sd"), F.min("_x").alias("_mn"), F.max("_x").alias("_mx"))
    s = (s.withColumn("_bw", F.col("_sd") * factor).withColumn("_d", (F.col("_mx") - F.col("_mn")) / bins)
          .withColumn("_glo", F.col("_mn") - F.lit(cut) * F.col("_bw"))
          .withColumn("_gstep", (F.col("_mx") - F.col("_mn") + F.lit(2 * cut) * F.col("_bw")) / F.lit(gridsize - 1)))
    at = F.try_divide(F.col("_x") - F.col("_mn"), F.col("_d"))
    low = F.least(F.floor(at), F.lit(bins - 1)).cast("int")
    both = (with_stats(vals, s.select("_mn", "_d", "_bw")).where(F.col("_bw") > 0)
            .select(low.alias("_low"), (at - low).alias("_part"))
            .groupBy("_low").agg(F.count("*").alias("_c"), F.sum("_part").alias("_right")))
    nodes = (both.select(F.explode(F.array(F.struct(F.col("_low").alias("j"), (F.col("_c") - F.col("_right")).alias("w")),
                                           F.struct((F.col("_low") + 1).alias("j"), F.col("_right").alias("w")))).alias("_e"))
             .select("_e.*").groupBy("j").agg(F.sum("w").alias("w")))
    # bins + 1 rows, each into gridsize rows: a bounded table whatever the input
    pairs = with_stats(nodes, s).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))))
    u = (F.col("_glo") + F.col("k") * F.col("_gstep") - (F.col("_mn") + F.col("j") * F.col("_d"))) / F.col("_bw")
    summed = pairs.groupBy("k").agg(F.sum(F.col("w") * F.exp(-0.5 * u * u)).alias("_ksum"))
    norm = F.lit(1.0 / math.sqrt(2.0 * math.pi))
    out = s.select(F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("k"), "_glo", "_gstep", "_n", "_bw", "_d").join(summed, "k", "left")
    return out.select("k", (F.col("_glo") + F.col("k") * F.col("_gstep")).alias("x"),
                      F.try_divide(F.coalesce(F.col("_ksum"), F.lit(0.0)) * norm, F.col("_n") * F.col("_bw")).alias("density"),
                      F.try_divide(F.col("_d") * F.col("_d") * norm, 8 * F.col("_bw") * F.col("_bw") * F.col("_bw")).alias("error"))


def stacked_bar_table(df: DataFrame, key: str, label: str = "churn", percent: bool = True,
                      classes: Sequence = rates.CLASSES) -> DataFrame:
    """CH4: per category and class the bar height (count or row percent) and its text label."""
    ct = rates.crosstab(df, key, label, classes=classes)
    if percent:
        ct = rates.row_percent(ct, classes).select(key, *[F.col(rates.pct_col(v)).alias(rates.class_col(v))
                                                          for v in classes])
    long = ct.select(key, F.explode(F.array(*[F.struct(F.lit(v).alias("class"),
                                                       F.col(rates.class_col(v)).cast("double").alias("height"))
                                              for v in classes])).alias("_b")).select(key, "_b.*")
    return long.withColumn("label", bar_label("height"))


def heatmap_cells(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """CH5: correlation matrix cells (a, b, r) with the annotation text."""
    c = correlation(df, columns)
    return c.withColumn("text", F.when(F.col("r").isNotNull(), F.format_string(f"%.{digits}f", F.col("r"))))
