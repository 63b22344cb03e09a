"""Profiling operators (IN1-IN10) and global statistics (AG9, AG10, AG13).

Every profile is one (or a few) aggregations over the whole table that end
in a small long-form result: one row per column, never per input row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlab.operators import ordered
from churnlab.operators.joins import with_stats
from churnlab.operators.rates import numeric_columns

DUP_CHUNK = 1_000_000


def head(df: DataFrame, n: int = 5, order_by: str | Sequence[str] = "id") -> DataFrame:
    """IN1: first n rows in key order (Spark rows have no file order)."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*keys).limit(n)


def row_count(df: DataFrame, name: str = "n_rows") -> DataFrame:
    """IN2: number of rows, as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias(name))


def _explode_struct_row(one_row: DataFrame, structs) -> DataFrame:
    return one_row.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def info(df: DataFrame) -> DataFrame:
    """IN3: (position, column, non_null, dtype) for every column - one aggregation."""
    cols = df.columns
    counts = df.agg(*[F.count(F.col(c)).alias(f"_n{i}") for i, c in enumerate(cols)])
    dtypes = dict(df.dtypes)
    structs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                        F.col(f"_n{i}").alias("non_null"), F.lit(dtypes[c]).alias("dtype"))
               for i, c in enumerate(cols)]
    return _explode_struct_row(counts, structs)


def columns_table(df: DataFrame, name: str = "Columns") -> DataFrame:
    """IN4 / SC2: the column listing as a table (position, name)."""
    rows = [(i, c) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, f"position int, {name} string")


def describe(df: DataFrame, columns: Sequence[str] | None = None,
             partitions: int | None = None) -> DataFrame:
    """IN5: count, mean, sample std, min, exact 25/50/75 % and max per numeric column.

    Moments come from one aggregation; quartiles from ``ordered.exact_quantiles``
    (distributed, exact, linear interpolation like pandas).  ``df.summary()``
    is not used: its quartiles are approximate and its output is text.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    one = df.agg(*[agg for i, c in enumerate(cols) for agg in (
        F.count(c).alias(f"_c{i}"), F.avg(c).alias(f"_m{i}"), F.stddev_samp(c).alias(f"_s{i}"),
        F.min(F.col(c).cast("double")).alias(f"_lo{i}"), F.max(F.col(c).cast("double")).alias(f"_hi{i}"))])
    structs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                        F.col(f"_c{i}").alias("count"), F.col(f"_m{i}").alias("mean"),
                        F.col(f"_s{i}").alias("std"), F.col(f"_lo{i}").alias("min"),
                        F.col(f"_hi{i}").alias("max")) for i, c in enumerate(cols)]
    moments = _explode_struct_row(one, structs)
    q = ordered.exact_quantiles(df, cols, [0.25, 0.5, 0.75], ["p25", "p50", "p75"], partitions)
    return (moments.join(q, "column", "left")
                   .select("position", "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"))


def missing_pct(df: DataFrame, columns: Sequence[str] | None = None, name: str = "pct_missing") -> DataFrame:
    """IN6: percentage of NULL values per column, long form (position, column, pct)."""
    cols = list(columns) if columns is not None else df.columns
    one = df.agg(*[(F.avg(F.col(c).isNull().cast("double")) * 100).alias(f"_p{i}") for i, c in enumerate(cols)])
    structs = [F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"_p{i}").alias(name))
               for i, c in enumerate(cols)]
    return _explode_struct_row(one, structs)


def missing_pct_rounded(df: DataFrame, column: str, digits: int = 0) -> DataFrame:
    """IN7: missing percentage of one column, rounded half-to-even."""
    return df.agg(F.bround(F.avg(F.col(column).isNull().cast("double")) * 100, digits).alias("pct_missing"))


def frequencies(df: DataFrame, column: str, value: str = "value", count: str = "count") -> DataFrame:
    """IN8: value counts of one column, count descending (value as tie-break), NULLs excluded."""
    return (df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias(value))
              .agg(F.count(F.lit(1)).alias(count))
              .orderBy(F.col(count).desc(), F.col(value)))


def _pair_moments(k: int):
    """Per Arrow batch: pairwise-complete sums of a centred k-column block, upper triangle."""
    import numpy as np
    import pandas as pd

    ii, jj = np.triu_indices(k)

    def run(batches):
        for pdf in batches:
            x = pdf.to_numpy(dtype="float64", na_value=np.nan)
            m = ~np.isnan(x)
            x0 = np.where(m, x, 0.0)
            mf = m.astype("float64")
            n = mf.T @ mf
            sx = x0.T @ mf          # sx[i, j]: sum of x_i over rows where x_i and x_j are present
            sxx = (x0 * x0).T @ mf
            sxy = x0.T @ x0
            yield pd.DataFrame({"i": ii.astype("int32"), "j": jj.astype("int32"), "n": n[ii, jj],
                                "sx": sx[ii, jj], "sy": sx[jj, ii], "sxx": sxx[ii, jj],
                                "syy": sxx[jj, ii], "sxy": sxy[ii, jj]})
    return run


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """IN9: Pearson correlation of every pair (a, b), pairwise-complete rows, long form.

    Columns are centred on their means (a one-row aggregate, so the sums
    below do not cancel), then each Arrow batch yields the pairwise-complete
    count, sums, squares and cross products of every column pair as k x k
    matrix products (``mapInPandas``: O(rows x k^2) in BLAS); a grouped sum
    per pair combines the batches with a tiny shuffle.  NULLs are skipped
    pairwise as pandas does; a constant column gives NULL.
    (One aggregation with k^2 ``corr`` columns spends minutes in planning
    and code generation for a few dozen columns; ``pyspark.ml.stat.Correlation``
    does not skip NULLs pairwise.)
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    k = len(cols)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"_m{i}") for i, c in enumerate(cols)])
    centred = with_stats(df.select(*cols), means).select(
        *[(F.col(c).cast("double") - F.col(f"_m{i}")).alias(f"c{i}") for i, c in enumerate(cols)])
    schema = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
    parts = centred.mapInPandas(_pair_moments(k), schema)
    g = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    cov = F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n)
    vx = F.greatest(F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n), F.lit(0.0))
    vy = F.greatest(F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n), F.lit(0.0))
    # clamp rounding overshoot to [-1, 1]; greatest/least skip NULLs, so guard them
    ok = (n >= 2) & (vx > 0) & (vy > 0)
    r = F.when(ok, F.least(F.greatest(cov / F.sqrt(vx * vy), F.lit(-1.0)), F.lit(1.0)))
    g = g.select("i", "j", r.alias("r"))
    mirrored = g.unionByName(g.where(F.col("i") != F.col("j"))
                              .select(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    names = F.array(*[F.lit(c) for c in cols])
    return mirrored.select(F.element_at(names, F.col("i") + 1).alias("a"),
                           F.element_at(names, F.col("j") + 1).alias("b"), "r")


#: Bits of the filter of repeated row hashes: 128 kB, whatever the table.
FILTER_BITS = 1 << 20


def _row_hash(cols: Sequence[str]) -> Column:
    """64 bits of a row; which values are missing counts too (the hash of a NULL alone would be no hash)."""
    return F.xxhash64(*cols, *(F.col(c).isNull() for c in cols))


def _bits(h: Column, bits: int) -> list[tuple[Column, Column]]:
    """(word, bit) of the two places of a hash in a filter of ``bits`` bits."""
    places = (F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 32), F.lit(bits)))
    return [(F.shiftright(at, 6).cast("int"), (at % 64).cast("int")) for at in places]


def repeated_filter(df: DataFrame, columns: Sequence[str], bits: int = FILTER_BITS) -> DataFrame:
    """One row, ``words``: a Bloom filter (array of 64-bit words) of the hashes of rows that occur twice or more.

    Only the 8-byte hashes are shuffled.
    """
    twice = df.select(_row_hash(columns).alias("_h")).groupBy("_h").count().where("count > 1")
    marks = [F.struct(w.alias("word"), b.alias("bit")) for w, b in _bits(F.col("_h"), bits)]
    words = (twice.select(F.explode(F.array(*marks)).alias("m")).groupBy(F.col("m.word").alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(1L, m.bit)")).alias("bits")))
    spine = df.sparkSession.range(bits // 64, numPartitions=1).select(F.col("id").cast("int").alias("word"))
    full = spine.join(words, "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
    # a bounded list: bits / 64 words
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w["bits"]).alias("words"))


def duplicated_rows(df: DataFrame, columns: Sequence[str] | None = None, filter_bits: int = FILTER_BITS) -> DataFrame:
    """IN10: second and later copies of fully duplicated rows (pandas ``duplicated()``).

    Rows are grouped on all columns (NULLs group together, as in pandas) and
    each group with count c > 1 emits c - 1 copies.  The copies are identical,
    so no order is needed.  Before whole rows are shuffled, a filter built from
    their hashes keeps those that may occur twice: where rows are distinct, 8
    bytes a row cross the network instead of the row.  A filter filled by very
    many duplicates lets more rows through and changes no result.  ``df`` is
    read twice: pass a stored table if it is costly.
    """
    names = list(columns) if columns is not None else df.columns
    cols = [f"_d{i}" for i in range(len(names))]        # the rows' own names may clash with the helpers'
    rows = df.select(*(F.col(c).alias(d) for c, d in zip(names, cols, strict=True)))
    chunk = F.lit(DUP_CHUNK).cast("bigint")
    maybe = rows.withColumn("_words", repeated_filter(rows, cols, filter_bits).scalar())
    for word, bit in _bits(_row_hash(cols), filter_bits):
        maybe = maybe.where(F.call_function("bit_get", F.get("_words", word), bit) == 1)
    g = maybe.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > 1)
    # copies 2..c are emitted in chunks of DUP_CHUNK so one huge duplicate group
    # never builds one giant array; the chunk rows are spread before expansion
    starts = (g.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_c") - 2) / chunk))))
               .withColumn("_s", F.col("_s") * chunk + 2))
    starts = starts.repartition(*[F.col(c) for c in cols], F.col("_s"))
    out = starts.withColumn("_k", F.explode(F.sequence(F.col("_s"), F.least(F.col("_s") + chunk - 1, F.col("_c")))))
    return out.select(*(F.col(d).alias(c) for c, d in zip(names, cols, strict=True)))


def medians(df: DataFrame, columns: Sequence[str], partitions: int | None = None) -> DataFrame:
    """AG9: exact median of each column, one row, columns named as the inputs."""
    return ordered.quantile_row(df, columns, 0.5, partitions=partitions)


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AG10: most frequent value of each column (smallest on ties), long form."""
    return ordered.modes(df, columns)


def quartiles(df: DataFrame, column: str, probs: Sequence[float] = (0.25, 0.75),
              partitions: int | None = None) -> DataFrame:
    """AG13: exact linear percentiles of one column (default 25th and 75th)."""
    return ordered.exact_quantiles(df, [column], probs, partitions=partitions)
