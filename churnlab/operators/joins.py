"""Joins (JO1-JO4).

No side is broadcast by a hint: joins are shuffle joins and adaptive execution
switches them from measured sizes.  One-row statistics (global aggregates) are
not joined at all: they enter as scalar subqueries (``with_stats``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def with_stats(df: DataFrame, stats: DataFrame, name: str = "_stats") -> DataFrame:
    """Attach the columns of a one-row statistics frame (a global aggregate) to every row.

    The row is packed into one struct and referenced as a single scalar
    subquery: Spark computes the aggregate once and uses it as a constant -
    no join, no broadcast of a table, and a frame with more than one row
    fails at run time instead of multiplying rows.
    """
    packed = stats.select(F.struct(*[F.col(c) for c in stats.columns]).alias(name)).scalar()
    out = df.withColumn(name, packed)
    return out.withColumns({c: F.col(name)[c] for c in stats.columns}).drop(name)


def _non_null_key(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull())


def join_churn(customers: DataFrame, churn: DataFrame, key: str = "id") -> DataFrame:
    """JO1: inner 1:1 equi-join of customers to their churn flag.

    Null keys are rejected up front (pandas would match NULL to NULL; SQL never does).
    Both sides are large at scale, so this is a sort-merge join on ``key``;
    AQE turns it into a broadcast join when a side turns out small.
    """
    return _non_null_key(customers, key).join(_non_null_key(churn, key), key, "inner")


def join_history(entities: DataFrame, history: DataFrame, key: str = "id",
                 salt_buckets: int = 0, salt_cols: list[str] | None = None) -> DataFrame:
    """JO2: inner 1:many join of one-row-per-key entities to a long history table.

    With ``salt_buckets > 1`` the join is salted: every history row gets a
    deterministic salt from a hash of ``salt_cols`` (re-executions see the same
    salt) and every entity row is replicated once per salt, so a key holding a
    large share of the history is spread over ``salt_buckets`` tasks.
    Without salting AQE's skew-join split handles moderate skew.
    """
    e, h = _non_null_key(entities, key), _non_null_key(history, key)
    if salt_buckets <= 1:
        return e.join(h, key, "inner")
    cols = [F.col(c) for c in (salt_cols or [c for c in h.columns if c != key])]
    h = h.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(salt_buckets)))
    e = e.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                    F.lit(salt_buckets - 1).cast("bigint"))))
    return e.join(h, [key, "_salt"], "inner").drop("_salt")


def class_columns(df: DataFrame, value: str, label: str = "churn",
                  names: tuple[str, str] = ("retention", "churn_value")) -> DataFrame:
    """JO4: side-by-side class columns on the same row (no positional join needed)."""
    lab, v = F.col(label), F.col(value)
    return df.select(*[c for c in df.columns if c not in (value,)],
                     F.when(lab == 0, v).alias(names[0]),
                     F.when(lab == 1, v).alias(names[1]))


def no_join_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """JO3: the reference's index-aligned merges become column expressions on the same row."""
    return df.withColumns(exprs)
