"""Deterministic row splits: hold-out split (ML2) and stratified folds (ML10).

Both derive from an MD5 hash of (seed, key) instead of a random number, so
a recomputed partition (lost executor, re-run) assigns every row to the
same side / fold, and the assignment can be reproduced in SQL.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlab.operators import ordered
from churnlab.session import materialize

#: Bits of the number that orders rows for an exact split, and the ranges one pass counts.
HASH_BITS = 60
RANGES = 4_096
#: Distinct numbers of a range that the driver puts in order.
LISTED = 10_000


def key_hash(key_cols: Sequence[str], seed: int = 42) -> Column:
    """md5 of '<seed>:<k1>|<k2>...' as hex text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])))


def hash_bucket(key_cols: Sequence[str], seed: int = 42, buckets: int = 10000) -> Column:
    """First 32 bits of the key hash, modulo ``buckets``."""
    return F.conv(F.substring(key_hash(key_cols, seed), 1, 8), 16, 10).cast("bigint") % buckets


def train_test_split(df: DataFrame, key_cols: Sequence[str], test_size: float = 0.33,
                     seed: int = 42, col: str = "is_test") -> DataFrame:
    """ML2: flag rows of the hold-out set (share close to ``test_size``; hash based, not exact)."""
    return df.withColumn(col, (hash_bucket(key_cols, seed) < int(round(test_size * 10000))).cast("int"))


def split(df: DataFrame, key_cols: Sequence[str], test_size: float = 0.33, seed: int = 42):
    """ML2: (train, test) frames."""
    flagged = train_test_split(df, key_cols, test_size, seed, "_t")
    return flagged.where("_t = 0").drop("_t"), flagged.where("_t = 1").drop("_t")


def key_number(key_cols: Sequence[str], seed: int = 42) -> Column:
    """First 60 bits of the key hash as a number."""
    return F.conv(F.substring(key_hash(key_cols, seed), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def kth_smallest(df: DataFrame, column: str, k_of: Callable[[int], int], bits: int = HASH_BITS) -> tuple[int, int, int, int] | None:
    """(value, rows below it, rows equal to it, k) of the k-th smallest of a long column from 0 to 2^bits - 1.

    ``k_of`` gives k (from 1) for the number of rows.  Every pass counts the
    rows of at most ``RANGES`` equal ranges (combined map-side, that many rows
    to the driver) and goes on inside the one that holds rank k, until few
    distinct numbers are left, which are listed.  Nothing is sorted or written;
    None if there is no row.
    """
    low, width, below, k = 0, 1 << bits, 0, None
    while True:
        inside = df.where((F.col(column) >= low) & (F.col(column) < low + width)) if k else df
        step = -(-width // RANGES)
        at = F.expr(f"(`{column}` - {low}L) div {step}L")
        counts = sorted((r["at"], r["n"], r["kinds"]) for r in inside.groupBy(at.alias("at")).agg(
            F.count("*").alias("n"), F.approx_count_distinct(column).alias("kinds")).collect())
        if k is None:
            n = sum(c for _, c, _ in counts)
            if not n:
                return None
            k = k_of(n)
        for i, c, kinds in counts:
            if below + c >= k:
                break
            below += c
        low, width = low + i * step, step
        if width == 1:
            return low, below, c, k
        if kinds <= LISTED // 2:         # an estimate: the list is cut just above the bound, and the passes go on then
            listed = (df.where((F.col(column) >= low) & (F.col(column) < low + width)).groupBy(column).count()
                      .limit(LISTED + 1).collect())
            if len(listed) <= LISTED:
                for value, c in sorted((r[0], r[1]) for r in listed):
                    if below + c >= k:
                        return value, below, c, k
                    below += c


def exact_train_test_split(df: DataFrame, key_cols: Sequence[str], test_size: float = 0.33, seed: int = 42,
                           col: str = "is_test") -> DataFrame:
    """ML2: flag exactly ``ceil(test_size * n)`` rows for the hold-out set, those with the smallest key hashes.

    The cut is found by counting ranges of the hash (``kth_smallest``), so
    nothing is shuffled but counts, and the flag is a comparison with a
    constant.  Rows with the hash of the cut (usually one) are taken in the
    order of their keys, then of a hash of all columns; only identical rows
    are interchangeable, and they are numbered by range, so a key that holds
    most rows is no hot task.  ``df`` is read two to six times: pass a stored
    table if it is costly.  An empty table stays empty.
    """
    if not 0 <= test_size <= 1:
        raise ValueError("test_size between 0 and 1")
    hashed = df.withColumn("_h", key_number(key_cols, seed))
    found = kth_smallest(hashed.select("_h"), "_h", lambda n: max(1, math.ceil(test_size * n))) if test_size else None
    if found is None:
        return df.withColumn(col, F.lit(0))
    value, below, equal, k = found
    if below + equal == k:
        return hashed.withColumn(col, (F.col("_h") <= value).cast("int")).drop("_h")
    ties = materialize(hashed.where(F.col("_h") == value).withColumns(
        {"_r": F.xxhash64(*df.columns), "_u": F.monotonically_increasing_id()}), "split_ties")
    order = [*(F.col(c).asc_nulls_first() for c in key_cols), F.col("_r"), F.col("_u")]
    cut = ordered.row_numbers(ties, [], order, "_n", stored=True).withColumn(col, (F.col("_n") <= k - below).cast("int"))
    rest = hashed.where(F.col("_h") != value).withColumn(col, (F.col("_h") < value).cast("int"))
    return rest.select(*df.columns, col).unionByName(cut.select(*df.columns, col))


def stratified_folds(df: DataFrame, label: str, key_cols: Sequence[str], k: int = 3, seed: int = 42,
                     col: str = "fold", exact: bool = True, unique_keys: bool = False, stored: bool = False) -> DataFrame:
    """ML10: shuffled stratified k-fold numbering.

    Within each class rows are ordered by the key hash (ties by key) and
    numbered; fold = (row number - 1) mod k, so every fold gets the same
    share of each class (to within one row).  The numbering uses
    ``ordered.row_numbers``: a class holding most rows is still spread over
    many tasks.  Rows with equal keys follow a hash of all their columns, so
    only identical rows are interchangeable and the folds don't depend on
    how rows arrive; a NULL label is a class of its own.  With ``unique_keys``
    (the caller guarantees the keys identify rows) only the narrow key
    projection is numbered and joined back - cheaper for wide rows; with
    repeated keys that join would multiply rows, so it is opt-in.  ``stored``:
    ``df`` reads a stored table, which is not stored once more to count it.

    ``exact=False`` assigns fold = hash bucket mod k instead: no numbering, no
    join, no shuffle - each class is split into near-equal (not exactly
    equal) parts, which is enough when folds hold millions of rows.
    """
    if not exact:
        return df.withColumn(col, (hash_bucket(list(key_cols), seed, 1 << 30) % k).cast("int"))
    keys = list(key_cols)
    # the hash as 16 bytes: they order as its text does
    hashed = {"_h": F.unhex(key_hash(keys, seed))}
    order = [F.col("_h"), *[F.col(c) for c in keys]]
    if not unique_keys:
        rn = ordered.row_numbers(df, [label], [*order, F.col("_r")], "_rn", stored=stored,
                                 helpers=hashed | {"_r": F.xxhash64(*[F.col(c) for c in df.columns])})
        return rn.withColumn(col, ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")
    rn = ordered.row_numbers(df.select(*keys, label), [label], order, "_rn", stored=stored, helpers=hashed)
    folds = rn.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
                      ((F.col("_rn") - 1) % k).cast("int").alias(col))
    same = F.lit(True)
    for i, c in enumerate(keys):
        same = same & df[c].eqNullSafe(folds[f"_k{i}"])
    return df.join(folds, same).drop(*[f"_k{i}" for i in range(len(keys))])


def grouped_stratified_folds(df: DataFrame, label: str, group_col: str = "id", k: int = 3, seed: int = 42,
                             col: str = "fold") -> DataFrame:
    """ML10 by customer: all rows of a group share one fold; folds are stratified over groups.

    The reference splits customer x date rows, so one customer lands on both
    sides (SURVEY note 3).  Here the (group, label) pairs are numbered - one
    row per customer, the label being a customer attribute - and joined back
    on the group key (unique on that side, so no row is multiplied).
    """
    groups = df.select(group_col, label).dropDuplicates([group_col])
    folds = stratified_folds(groups, label, [group_col], k, seed, col, unique_keys=True)
    folds = folds.select(F.col(group_col).alias("_g"), col)
    return df.join(folds, df[group_col].eqNullSafe(folds["_g"])).drop("_g")
