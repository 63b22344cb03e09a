"""Bucketed tables for a join that is repeated (JO2): the shuffle is paid once, when a table is stored.

Both sides are stored in the same number of buckets of the join key, sorted
inside each bucket; the catalog keeps the bucket spec.  A join on the key then
reads matching buckets together, without exchange or sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from churnlab.session import shared_path

#: Bytes of one bucket to aim at.
BUCKET_BYTES = 256 << 20


def bucket_count(total_bytes: int, least: int = 8) -> int:
    """A power of two of buckets of about ``BUCKET_BYTES``; tables joined with each other must share it."""
    n = least
    while n * BUCKET_BYTES < total_bytes:
        n *= 2
    return n


def store(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Store ``df`` as table ``name`` in ``buckets`` buckets of ``key`` in the shared folder; a table of that name is replaced.

    Rows are dealt by the key first, so each bucket is one sorted file, not one
    per task.  A null key has a bucket like any other.
    """
    spark = df.sparkSession
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
       .option("path", shared_path(spark, f"buckets/{name}")).saveAsTable(name))
    return spark.table(name)
