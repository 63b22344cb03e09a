"""SparkSession factory and cluster-facing settings.

Everything in the library is plain DataFrame code; this module only pins the
settings the operators rely on: UTC session time zone (date arithmetic),
ANSI mode (bad casts fail loudly; operators use ``try_*`` where pandas would
yield NaN), fair scheduling between threads, adaptive execution with skew-join splitting, and a shared
checkpoint folder taken from ``spark.checkpoint.dir`` when the cluster sets one.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.scheduler.mode": "FAIR",     # fits that run side by side share the cores
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "churnlab",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or fetch) a session with the library's settings.

    On a cluster pass ``master=None`` and let spark-submit decide; the
    settings above are only defaults and never override explicit ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, configuring one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/...) folder
    and is used as-is; without it this raises, as executors would each write to
    their own disk.  Only with a ``local`` master (tests) a fresh folder under
    the system temp directory is made.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="churnlab-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for intermediate tables/models inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "churnlab", *_scope, name)


_scope: list[str] = []


@contextmanager
def stage_scope(spark: SparkSession):
    """Stages written inside the block are deleted when it ends.

    Store what should outlive it (``df.write`` or an action) inside the block:
    results that still read a stage can't be computed afterwards.
    """
    _scope.append(f"scope-{uuid.uuid4().hex}")
    path = shared_path(spark, "")
    try:
        yield
    finally:
        _scope.pop()
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet into the shared checkpoint folder and read it back.

    Used at stage boundaries of long flows: each one-row-statistics step
    references its input twice, so an unbroken chain of k such steps would
    re-scan the sources about 2^k times.  A parquet stage keeps column
    pruning and predicate pushdown for the readers, lives on shared storage
    (a lost executor does not lose it - unlike a cache) and cuts the lineage.
    """
    path = shared_path(df.sparkSession, f"stages/{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
