"""Scans of the three churn tables (SC1) with explicit schemas.

CSV columns are matched to the schema by the names in the header line (their
order and extra columns don't matter); types are fixed, so there is no
inference pass over the data.  Parquet keeps its own schema; a ``schema`` argument selects and
checks columns so that Catalyst prunes the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from churnlab import schemas


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """SC1: CSV read by header name with the schema's types; other columns are ignored.

    A missing column, files whose headers differ and a value that doesn't fit
    its column's type raise; nothing turns into NULL unseen.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    types = {f.name: f.dataType for f in schema.fields}
    as_found = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    df = (spark.read.schema(as_found).option("header", True).option("enforceSchema", False)
               .option("mode", "FAILFAST").csv(path))
    return df.select(*schema.names)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan; with ``schema`` only those columns are read (and must exist)."""
    df = spark.read.parquet(path)
    if schema is None:
        return df
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path}: missing columns {missing}")
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema.fields])


def read_customers(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CUSTOMER_SCHEMA)


def read_churn(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CHURN_SCHEMA)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.PRICE_SCHEMA)
