"""Small helpers shared by the operators: table access, stages, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlab.session import shared_path

#: Text bytes handled at once by the Python side of an operator.  Arrow batches
#: hold 10,000 rows whatever their size; slicing them keeps a worker's memory
#: bounded by this plus the longest single text.
CHUNK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the cluster's shared folder and read it back.

    Cuts the lineage, survives lost executors, and later readers prune columns.
    """
    path = shared_path(df.sparkSession, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def aliased(df: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """The table under names no operator uses, and the new name of each column."""
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names.__getitem__


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that no model may learn from: crc32(id as text) mod 4 is 2."""
    crc = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most CHUNK_BYTES of text, or one row."""
    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > CHUNK_BYTES:
                yield b.slice(start, i - start)
                start, total = i, 0
            total += n
        if b.num_rows > start:
            yield b.slice(start)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [x or "" for x in batch.column(text).to_pylist()]


def map_texts(df: DataFrame, fn: Callable[[list[str]], dict[str, object]], schema: str,
              keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """Apply ``fn(list of texts) -> {column: values}`` batch by batch.

    ``keep`` columns pass through unchanged and come first; only they and the
    text column are read.  ``schema`` is the DDL of the columns that fn adds.
    """
    src = df.select(*dict.fromkeys((*keep, text)))
    out = src.select(*keep).schema
    for f in _ddl(schema):
        out = out.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(out)
        for b in slices(batches, text):
            got = fn(texts_of(b, text))
            cols = [b.column(k) for k in keep] + [got[f.name] for f in out.fields[len(keep):]]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type)
                 for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return src.mapInArrow(run, out)


def _ddl(schema: str) -> list:
    from pyspark.sql.types import StructType
    return StructType.fromDDL(schema).fields


def labelled_sample(labels: DataFrame, label: str, per_class: int, key: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """At most about ``per_class`` (key, label) rows of each class to learn from, and each class's full count.

    Held-out rows, null ids and labels other than 0 and 1 are left out; an id
    with both labels counts as 0.  Rows are taken by a hash of the id, so the
    same rows come whatever the partitioning; a limit guards the bound.
    """
    known = (labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(key))
             .groupBy(key).agg(F.min(label).cast("int").alias("label")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    return by_hash(known, counts, "label", per_class, key), counts


def by_hash(df: DataFrame, counts: dict, column: str, per_class: int, key: str = "doc_id") -> DataFrame:
    """About ``per_class`` rows of each class in ``counts`` (at most 1.3 times as many), by a hash of the key."""
    picked = F.lit(False)
    at = F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 20))
    for value, n in counts.items():
        picked = picked | ((F.col(column) == F.lit(value)) & (at < F.lit(int((1 << 20) * min(1.0, per_class / n)) + 1)))
    return df.where(picked).limit(int(1.3 * per_class * max(1, len(counts))))
