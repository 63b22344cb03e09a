"""Feature engineering (FE1-FE8)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlab.functions import dates as D
from churnlab.functions import scalar as S
from churnlab.operators import project
from churnlab.operators.clean import negatives_to_null
from churnlab.operators.profile import correlation

# Fixed values of the reference analysis.
REFERENCE_DATE = "2016-01-01"
PRICE_WINDOWS = {"year": None, "6m": "2015-06-01", "3m": "2015-10-01"}
MAX_CATEGORIES = 1000


def price_window_means(prices: DataFrame, measures: Sequence[str], key: str = "id",
                       date_col: str = "price_date", windows: Mapping[str, str | None] = PRICE_WINDOWS,
                       pairs: Mapping[str, tuple[str, str]] | None = None) -> DataFrame:
    """FE1: per-key means of each measure over the whole history and after each (strict) date bound.

    One aggregation (one shuffle on ``key``) with conditional means replaces
    three filtered group-bys.  A key with no rows after a bound gets NULL
    means for that window.  Output names: ``mean_<window>_<measure>`` plus,
    for every ``pairs`` entry ``out: (a, b)``, ``mean_<window>_<out>`` = sum of
    the two window means.
    """
    d = D.as_date(prices, date_col)
    aggs = []
    for w, bound in windows.items():
        keep = None if bound is None else d > F.to_date(F.lit(bound))
        for m in measures:
            v = F.col(m) if keep is None else F.when(keep, F.col(m))
            aggs.append(F.avg(v).alias(f"mean_{w}_{m}"))
    out = prices.groupBy(key).agg(*aggs)
    if pairs:
        out = out.withColumns({f"mean_{w}_{o}": F.col(f"mean_{w}_{a}") + F.col(f"mean_{w}_{b}")
                               for w in windows for o, (a, b) in pairs.items()})
    return out


def tenure(df: DataFrame, start: str = "date_activ", end: str = "date_end", name: str = "tenure") -> DataFrame:
    """FE2: whole years between two date columns (text or DATE)."""
    return df.withColumn(name, D.whole_years(D.as_date(df, end), D.as_date(df, start)))


def months_features(df: DataFrame, columns: Mapping[str, str], ref_date: str = REFERENCE_DATE,
                    negate: Sequence[str] = ("months_end",)) -> DataFrame:
    """FE3: whole months from each date column to ``ref_date``; names in ``negate`` are sign-flipped."""
    ref = F.to_date(F.lit(ref_date))
    exprs = {}
    for out, src in columns.items():
        m = D.whole_months(ref, D.as_date(df, src))
        exprs[out] = -m if out in negate else m
    return df.withColumns(exprs)


def encode_flag(df: DataFrame, column: str = "has_gas", mapping: Mapping | None = None) -> DataFrame:
    """FE4: 't'/'f' flag to 1/0 (other values become NULL)."""
    return df.withColumn(column, S.map_values(column, mapping or {"t": 1, "f": 0}))


def category_values(df: DataFrame, column: str, most: int = MAX_CATEGORIES) -> list | None:
    """Distinct non-null values of a category column, sorted; None if there are more than ``most``."""
    vals = (df.where(F.col(column).isNotNull()).select(column).distinct()
              .orderBy(column).limit(most + 1).collect())
    return None if len(vals) > most else [r[0] for r in vals]


def one_hot(df: DataFrame, column: str, prefix: str, width: int | None = None,
            null_label: str | None = None, drop_label: str | None = None,
            values: Sequence | None = None, keep_source: bool = False,
            max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """FE5: 0/1 dummy columns ``<prefix>_<value>`` (names cut to ``width``, collisions raise).

    NULLs are first filled with ``null_label`` (pandas ``fillna``); the dummy
    whose (cut) name equals ``drop_label`` is not created - the baseline
    category.  The category list is one bounded distinct job (the column set
    must be known to build the plan); pass ``values`` to skip it.  More than
    ``max_categories`` dummy columns can't be planned and raise: ask for the
    vector form (:func:`one_hot_vector`) then.
    """
    src = df
    if null_label is not None:
        src = src.withColumn(column, F.coalesce(F.col(column), F.lit(null_label)))
    cats = list(values) if values is not None else category_values(src, column, max_categories)
    if cats is None:
        raise ValueError(f"{column} has more than {max_categories} categories: use one_hot_vector")
    names = [f"{prefix}_{v}" for v in cats]
    if width is not None:
        names = project.truncate_names(names, width)
    dummies = {n: F.when(F.col(column) == F.lit(v), 1).otherwise(0) for n, v in zip(names, cats)
               if n != drop_label}
    out = src.withColumns(dummies)
    return out if keep_source else out.drop(column)


def one_hot_vector(df: DataFrame, column: str, prefix: str, null_label: str | None = None,
                   drop_label: str | None = None) -> DataFrame:
    """FE5 for any number of categories: ``<prefix>_index`` and the sparse 0/1 vector ``<prefix>``.

    Positions follow the categories' order; a NULL has the last position.
    ``null_label`` and ``drop_label`` as in :func:`one_hot`: with a baseline to
    drop, the vector holds the other categories in order, the baseline's rows
    are all zeros, and NULLs must have a label.  The model operators take the
    vector as a feature column (``model.feature_columns``).
    """
    if null_label is not None:
        df = df.withColumn(column, F.coalesce(F.col(column), F.lit(null_label)))
    index = f"{prefix}_index"
    indexer = StringIndexer(inputCol=column, outputCol=index, stringOrderType="alphabetAsc", handleInvalid="keep").fit(df)
    base = [v for v in indexer.labelsArray[0] if drop_label is not None and f"{prefix}_{v}" == drop_label]
    if base:
        others = [v for v in indexer.labelsArray[0] if v not in base]
        indexer = StringIndexerModel.from_labels([*others, *base], column, index, handleInvalid="error")
    indexed = indexer.transform(df)
    return OneHotEncoder(inputCol=index, outputCol=prefix, dropLast=bool(base)).fit(indexed).transform(indexed)


def fold_rare(df: DataFrame, column: str, threshold: int = 75, replacement: str = "null_activity",
              null_label: str | None = None) -> DataFrame:
    """FE6: categories seen at most ``threshold`` times are replaced by ``replacement``.

    One aggregation counts the categories; the rare ones stay distributed and
    are joined back (AQE broadcasts them where their measured size allows, and
    splits a category that fills a partition).  NULLs are filled with
    ``null_label`` first.
    """
    src = df
    if null_label is not None:
        src = src.withColumn(column, F.coalesce(F.col(column), F.lit(null_label)))
    counts = src.groupBy(column).agg(F.count(F.lit(1)).alias("_cat_n"))
    rare = counts.where(F.col("_cat_n") <= threshold).select(F.col(column).alias("_rare"))
    j = src.join(rare, F.col(column) == F.col("_rare"), "left")
    return j.withColumn(column, F.when(F.col("_rare").isNotNull(), F.lit(replacement))
                                 .otherwise(F.col(column))).drop("_rare")


def log_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """FE7: negatives to NULL, then log10(x + 1), for every column in one projection."""
    return negatives_to_null(df, columns).withColumns({c: S.log10p1(c) for c in columns})


def correlated_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """FE8 evidence: pairs (a before b) whose |Pearson r| exceeds ``threshold``."""
    cols = list(columns)
    pos = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    c = correlation(df, cols)
    return c.where((pos[F.col("a")] < pos[F.col("b")]) & (F.abs(F.col("r")) > threshold))


def correlated_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.9) -> list[str]:
    """FE8 helper: for each pair with |r| > threshold, the later column (one aggregation,
    a columns x columns matrix to the driver)."""
    cols = list(columns)
    rows = correlation(df, cols).collect()
    pos = {c: i for i, c in enumerate(cols)}
    drop: list[str] = []
    for r in sorted(rows, key=lambda r: (pos[r["a"]], pos[r["b"]])):
        a, b, v = r["a"], r["b"], r["r"]
        if pos[a] < pos[b] and v is not None and abs(v) > threshold and a not in drop and b not in drop:
            drop.append(b)
    return drop


def drop_correlated(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.9,
                    explicit: Sequence[str] | None = None) -> DataFrame:
    """FE8: drop an explicit list, or the later column of each highly correlated pair."""
    if explicit is not None:
        return df.drop(*explicit)
    return df.drop(*correlated_columns(df, columns, threshold))
