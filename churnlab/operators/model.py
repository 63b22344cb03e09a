"""Boosted-tree churn model on Spark ML (ML1, ML3-ML5, ML11, ML13-ML17).

XGBoost is replaced by ``pyspark.ml.classification.GBTClassifier``: trees are
grown level by level from statistics aggregated across executors, so the
training table is never gathered on one machine.  Parameter names of the
reference are mapped (``xgb_to_gbt``); ``scale_pos_weight`` becomes a weight
column, parameters without a Spark counterpart come back as ``unmapped``
(``unmapped_params``, and a column of the grid search's table), and values that
Spark cannot take raise.  GBT rejects NaN, so missing feature values are filled
and flagged first (``prepare_features``).

Scores will not equal XGBoost's; tests check properties (fixed-seed
repeatability, AUC above chance on informative data), never equality.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnlab.operators import metrics
from churnlab.operators.rates import numeric_columns
from churnlab.session import ensure_checkpoint_dir, materialize, shared_path

# The reference's base model and search grid (XGBoost names).
BASE_PARAMS = {"learning_rate": 0.1, "max_depth": 6, "n_estimators": 500}
REFERENCE_GRID = {"subsample": [0.7], "scale_pos_weight": [1], "n_estimators": [1100],
                  "min_child_weight": [1], "max_depth": [12, 13, 14],
                  "learning_rate": [0.005, 0.01], "gamma": [4.0], "colsample_bytree": [0.6]}
EXCLUDE = ("id", "churn", "price_date")
MAX_GBT_DEPTH = 30
#: Least gain of a split, XGBoost's own floor: below it a node of equal rows would be split by rounding errors.
MIN_GAIN = 1e-6


def _vectors(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, VectorUDT)]


def feature_columns(df: DataFrame, exclude: Sequence[str] = EXCLUDE) -> list[str]:
    """ML1: the model inputs - every numeric or vector column except the key, label and date.

    The category number that comes with a vector of dummies is no input.
    """
    vectors = _vectors(df)
    numeric = numeric_columns(df, exclude=[*exclude, *(f"{v}_index" for v in vectors)])
    return [c for c in df.columns if c in numeric or c in vectors and c not in exclude]


def feature_names(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The name of every position of the assembled vector; dummies of a vector column are ``<column>_<category>``."""
    names = []
    for c in columns:
        attrs = df.schema[c].metadata.get("ml_attr", {}).get("attrs", {}) if c in _vectors(df) else None
        if attrs is None:
            names.append(c)
        else:
            listed = sorted((a for kind in attrs.values() for a in kind), key=lambda a: a["idx"])
            names += [f"{c}_{a['name']}" for a in listed]
    return names


def _missing(c: str):
    return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))


def columns_with_nulls(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Which of ``columns`` hold a NULL or NaN (one aggregation, one row to the driver); vectors hold neither."""
    columns = [c for c in columns if c not in _vectors(df)]
    if not columns:
        return []
    row = df.agg(*[F.max(_missing(c).cast("int")).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def prepare_features(df: DataFrame, columns: Sequence[str], fill_value: float = 0.0) -> tuple[DataFrame, list[str]]:
    """Fill NULL/NaN features and add a ``<c>_missing`` 0/1 flag for each column that had any.

    XGBoost routes missing values itself; GBT throws on NaN, so the flag
    keeps the information.  Returns (frame, final feature column list).
    """
    nullable = columns_with_nulls(df, columns)
    exprs = {}
    for c in [c for c in columns if c not in _vectors(df)]:
        x = F.col(c).cast("double")
        exprs[c] = F.when(x.isNull() | F.isnan(x), F.lit(fill_value)).otherwise(x)
    flags = {f"{c}_missing": _missing(c).cast("double") for c in nullable}
    out = df.withColumns(flags).withColumns(exprs)
    return out, list(columns) + list(flags)


def assembler(columns: Sequence[str], output: str = "features") -> VectorAssembler:
    """ML1: feature vector of the given columns."""
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid="error")


def xgb_to_gbt(params: Mapping) -> tuple[dict, dict]:
    """Map XGBoost parameter names to GBTClassifier ones; returns (mapped, unmapped)."""
    mapped, unmapped = {}, {}
    for k, v in params.items():
        if k == "learning_rate":
            mapped["stepSize"] = float(v)
        elif k == "max_depth":
            if int(v) > MAX_GBT_DEPTH:
                raise ValueError(f"max_depth {v}: Spark trees are at most {MAX_GBT_DEPTH} deep")
            mapped["maxDepth"] = int(v)
        elif k == "n_estimators":
            mapped["maxIter"] = int(v)
        elif k == "subsample":
            mapped["subsamplingRate"] = float(v)
        elif k == "colsample_bytree":
            mapped["featureSubsetStrategy"] = str(v)  # per node in Spark, per tree in XGBoost
        elif k == "min_child_weight":
            if float(v) != int(v) or int(v) < 1:
                raise ValueError(f"min_child_weight {v}: Spark counts whole rows, at least 1")
            mapped["minInstancesPerNode"] = int(v)  # rows, not hessian sum
        elif k == "scale_pos_weight":
            pass  # a weight column, see with_class_weight
        elif k in ("silent", "nthread", "n_jobs", "objective", "verbosity"):
            pass  # cluster parallelism / binary logistic loss are implied
        else:
            unmapped[k] = v  # e.g. gamma: no equivalent (minInfoGain is in other units)
    return mapped, unmapped


def unmapped_params(params: Mapping | None) -> dict:
    """Parameters that have no effect on the Spark model."""
    return xgb_to_gbt(params or BASE_PARAMS)[1]


WEIGHT = "_class_weight"


def with_class_weight(df: DataFrame, params: Mapping | None, label: str) -> DataFrame:
    """``scale_pos_weight``: rows of class 1 count that much, others 1."""
    w = float((params or BASE_PARAMS).get("scale_pos_weight", 1))
    return df.withColumn(WEIGHT, F.when(F.col(label) == 1, F.lit(w)).otherwise(F.lit(1.0)))


def gbt(params: Mapping | None = None, label: str = "churn", features: str = "features",
        seed: int = 42, checkpoint_interval: int = 10) -> GBTClassifier:
    """ML3: a GBT classifier (logistic loss) from XGBoost-style parameters."""
    mapped, _ = xgb_to_gbt(params or BASE_PARAMS)
    if float((params or BASE_PARAMS).get("scale_pos_weight", 1)) != 1.0:
        mapped["weightCol"] = WEIGHT
    return GBTClassifier(featuresCol=features, labelCol=label, lossType="logistic", seed=seed, minInfoGain=MIN_GAIN,
                         checkpointInterval=checkpoint_interval, **mapped)


def fit(train: DataFrame, columns: Sequence[str], params: Mapping | None = None, label: str = "churn",
        seed: int = 42):
    """ML3: fit assembler + GBT; returns the fitted PipelineModel.

    The features are assembled and stored once, as a fit reads its rows three
    times before it holds them (labels, candidate splits, bins).  Long boosting
    runs cut their lineage every ``checkpointInterval`` iterations into the
    shared checkpoint folder.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    data = with_class_weight(train.withColumn(label, F.col(label).cast("double")), params, label)
    vectors = assembler(columns)
    path = shared_path(spark, f"stages/fit_features-{uuid.uuid4().hex}")
    data = vectors.transform(data).select(label, WEIGHT, "features")
    data.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    files = _one_file_a_partition(spark).read.schema(data.schema).parquet(path)
    rows = files.count()
    data = in_small_partitions(files.coalesce(tasks_of_fit(rows, max(1, spark.sparkContext.defaultParallelism))), rows)
    return PipelineModel([vectors, gbt(params, label, seed=seed).fit(data)])


def predict(model, df: DataFrame, keep: Sequence[str] = ("id", "churn")) -> DataFrame:
    """ML4/ML5: predicted label and class-1 probability for every row."""
    out = model.transform(df)
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array("probability")[1].alias("p_churn"))


def _auc_of(pred: DataFrame, label: str, group_cols=()) -> DataFrame:
    return metrics.auc(pred.withColumnRenamed(label, "label"), "label", "p_churn", group_cols)


def side_by_side(spark: SparkSession, tasks: Sequence[Callable[[], object]], parallelism: int | None = None) -> list:
    """Results of driver-side ``tasks`` whose Spark jobs run at the same time, each in a pool of its own.

    Pools share the executors' cores evenly where the session schedules
    ``FAIR`` (``session.get_spark`` does); under ``FIFO`` later jobs fill the
    cores that earlier ones leave idle.  The first error is raised.
    """
    tasks = list(tasks)

    @inheritable_thread_target(spark)
    def run(i: int):
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"churnlab-{i}")
        return tasks[i]()

    if not tasks:
        return []
    with ThreadPool(min(parallelism or len(tasks), len(tasks))) as pool:
        return pool.map(run, range(len(tasks)), chunksize=1)


#: Rows of a fit that one task holds, about 1 kB each as Spark's event log counts them; up to there a table has one partition a core.
ROWS_PER_TASK = 1_000_000
#: Bytes that a fit keeps in memory for a row (its objects, label, weight, errors) and for a feature of it (its bin).
ROW_BYTES, FEATURE_BYTES = 128, 4


def storage_bytes(spark: SparkSession) -> int:
    """Memory in which the executors can keep blocks; of several block managers one is the driver's and is left out."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().values().iterator()
    sizes = []
    while status.hasNext():
        sizes.append(int(status.next()._1()))
    return sum(sizes) - (max(sizes) if len(sizes) > 1 else 0)


def fits_at_once(storage: int, rows: int, features: int) -> int:
    """How many fits on ``rows`` rows keep their binned rows in ``storage`` bytes together; at least one.

    Every level of every tree reads all binned rows.  More fits at a time push
    them to disk, from where they come back row by row for each level.
    """
    return max(1, int(storage * 0.75) // max(1, rows * (ROW_BYTES + FEATURE_BYTES * features)))


def in_small_partitions(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as it is, or dealt anew if its ``rows`` rows are more than ``ROWS_PER_TASK`` a partition.

    Stored numbers take few bytes, so a split of a file can hold millions of rows
    that are many times as large once a fit keeps them in memory.
    """
    if df.rdd.getNumPartitions() * ROWS_PER_TASK >= rows:
        return df
    return df.repartition(math.ceil(rows / ROWS_PER_TASK))


#: Rows from which on one more task of a fit pays: below, starting it and merging its histograms costs more than its part of a level.
ROWS_WORTH_A_TASK = 50_000


def tasks_of_fit(rows: int, cores: int) -> int:
    """Partitions of a fit on ``rows`` rows: one a core where that pays, more only to keep a task to ``ROWS_PER_TASK`` rows."""
    if rows >= cores * ROWS_WORTH_A_TASK:
        return cores * max(1, math.ceil(rows / (cores * ROWS_PER_TASK)))
    return max(1, math.ceil(rows / min(ROWS_WORTH_A_TASK, ROWS_PER_TASK)))


#: Rows of one file of a table stored for fits: few against ``ROWS_PER_TASK``, so that whole files deal out evenly.
ROWS_PER_FILE = 100_000


def _one_file_a_partition(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` whose readers put every file in a partition of its own."""
    other = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            other.conf.set(k, v)
    other.conf.set("spark.sql.files.openCostInBytes", "1t")
    return other


def _store_for_fits(df: DataFrame, fold_col: str, name: str, share: float,
                    asked: int) -> tuple[DataFrame, Callable[[Column], DataFrame], int]:
    """``df`` stored by fold: the table, a function from a condition to the rows fitted, and how many fits run at a time.

    Every fit reads its features several times before it holds them.  A fold is
    a folder, so a fit or a score reads its folds only; files are small and
    dealt out whole to the partitions that ``tasks_of_fit`` counts.  No row is
    shuffled for a fit.  A task sends a histogram of every node of a level,
    whatever its rows, so partitions beyond the cores only multiply what deep
    trees shuffle, and those of a small table only add jobs' fixed time to every
    level of every tree.  ``share`` of the rows is fitted at a time.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"stages/{name}-{uuid.uuid4().hex}")
    df.write.option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(fold_col).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    rows = int(table.count() * share)
    first = table.select("features").first()
    held = fits_at_once(storage_bytes(spark), rows, first["features"].size if first else 1)
    tasks = tasks_of_fit(rows, max(1, spark.sparkContext.defaultParallelism))
    files = _one_file_a_partition(spark).read.schema(df.schema).parquet(path)
    return table, lambda condition: files.where(condition).coalesce(tasks), min(asked, held)


def store_folds(data: DataFrame, columns: Sequence[str], params: Mapping | None = None, label: str = "churn",
                fold_col: str = "fold", k: int = 3, keep: Sequence[str] = ("id",), parallelism: int | None = None):
    """The table that ``cross_validate`` stores, for validations of several parameters with one ``scale_pos_weight``."""
    ensure_checkpoint_dir(data.sparkSession)
    table = with_class_weight(data.withColumn(label, F.col(label).cast("double")), params, label)
    wanted = list(dict.fromkeys([*keep, label, fold_col, WEIGHT, "features"]))
    return _store_for_fits(assembler(columns).transform(table).select(*wanted), fold_col, "cv_features",
                           1 - 1 / k if k > 1 else 1, parallelism or k)


def cross_validate(data: DataFrame, columns: Sequence[str], params: Mapping | None = None,
                   label: str = "churn", fold_col: str = "fold", k: int = 3,
                   keep: Sequence[str] = ("id",), parallelism: int | None = None, stored=None):
    """ML11/ML16: per-fold fit; train AUC, test AUC and the test ROC points of each fold.

    The assembled features are stored once and read by all folds, which are
    fitted side by side (``parallelism`` at a time, all by default, but no more
    than the executors' memory holds, see ``fits_at_once``).  A fold's
    model scores the whole table in one scan; a row's side follows from its
    fold.  Rows without a fold train every model and are scored on no side.
    ``stored``: what ``store_folds`` gave for the same data, so that a second
    validation does not store it again.
    Returns (fold AUC table, ROC points, the last fold's fitted model).
    """
    spark = data.sparkSession
    table, fitting, held = stored or store_folds(data, columns, params, label, fold_col, k, keep, parallelism)

    def one(f: int):
        model = gbt(params, label).fit(fitting(~F.col(fold_col).eqNullSafe(F.lit(f))))
        side = F.when(F.col(fold_col) == f, "test").when(F.col(fold_col).isNotNull(), "train")
        pred = predict(model, table.withColumn("_side", side), [*keep, label, "_side"]).withColumn(fold_col, F.lit(f))
        return model, materialize(pred, f"cv_predictions_{f}")

    fitted = side_by_side(spark, [lambda f=f: one(f) for f in range(k)], held)
    pred = fitted[0][1]
    for _, p in fitted[1:]:
        pred = pred.unionByName(p)
    pred = pred.where(F.col("_side").isNotNull())
    each = _auc_of(pred, label, [fold_col, "_side"])
    fold_aucs = each.groupBy(fold_col).agg(*[F.max(F.when(F.col("_side") == s, F.col("auc"))).alias(f"auc_{s}")
                                             for s in ("train", "test")])
    roc = metrics.roc_curve(pred.where("_side = 'test'").withColumnRenamed(label, "label"), "label", "p_churn", [fold_col])
    return fold_aucs, roc, fitted[-1][0]


class ExactAUC(Evaluator):
    """Area under the ROC curve without binning, for model selection and Spark ML's tuning classes.

    ``BinaryClassificationEvaluator`` thins the curve to about 1,000 points, so
    candidates that differ by little can tie or change places; this one counts
    every distinct score (``metrics.auc``).  ``score`` is a number column or a
    vector column, of which the last value counts (class 1).  One class only,
    or no row, gives NaN, which never ranks first.
    """

    def __init__(self, label: str = "label", score: str = "rawPrediction"):
        super().__init__()
        self.label, self.score = label, score

    def isLargerBetter(self) -> bool:
        return True

    def _evaluate(self, dataset: DataFrame) -> float:
        vector = dataset.schema[self.score].dataType.typeName() not in ("double", "float", "integer", "long", "short", "byte")
        score = F.element_at(vector_to_array(self.score), -1) if vector else F.col(self.score).cast("double")
        scored = dataset.select(F.col(self.label).alias("label"), score.alias("score"))
        found = metrics.auc(scored).first()
        return float("nan") if found is None or found["auc"] is None else float(found["auc"])


def param_grid(grid: Mapping[str, Sequence] = REFERENCE_GRID) -> list[dict]:
    """ML13: the candidate list (every combination, in the grid's key order)."""
    keys = list(grid)
    return [dict(zip(keys, combo)) for combo in itertools.product(*[grid[k] for k in keys])]


def grid_search(data: DataFrame, columns: Sequence[str], grid: Mapping[str, Sequence] = REFERENCE_GRID,
                label: str = "churn", fold_col: str = "fold", k: int = 3, parallelism: int = 2, seed: int = 42):
    """ML14/ML15: k-fold grid search by exact area under ROC on the given folds.

    Returns (candidates table: candidate, params, unmapped, mean_auc, rank; best
    XGBoost-style parameters).  ``scale_pos_weight`` must be the same for all
    candidates: it is a column of the one table they share, whose features are
    assembled and stored once.  All fits, of every candidate and fold, run
    ``parallelism`` at a time, or fewer if the executors' memory holds fewer
    (``fits_at_once``).  A candidate with an undefined area (a fold of
    one class) ranks last; of equal areas the earlier candidate is better.
    """
    spark = data.sparkSession
    ensure_checkpoint_dir(spark)
    cands = param_grid(grid)
    if len({float(c.get("scale_pos_weight", 1)) for c in cands}) > 1:
        raise ValueError("search one scale_pos_weight at a time")
    weighted = with_class_weight(data.withColumn(label, F.col(label).cast("double")), cands[0], label)
    table, fitting, held = _store_for_fits(assembler(columns).transform(weighted).select(label, fold_col, WEIGHT, "features"),
                                           fold_col, "search_features", 1 - 1 / k if k > 1 else 1, parallelism)
    evaluator = ExactAUC(label)

    def area(c: Mapping, f: int) -> float:
        model = gbt(c, label, seed=seed).fit(fitting(F.col(fold_col) != f))
        return evaluator.evaluate(model.transform(table.where(F.col(fold_col) == f)))

    areas = side_by_side(spark, [lambda c=c, f=f: area(c, f) for c in cands for f in range(k)], held)
    means = [sum(areas[i * k:(i + 1) * k]) / k for i in range(len(cands))]
    means = [None if m != m else m for m in means]
    rows = [(i, str(c), str(unmapped_params(c)), m) for i, (c, m) in enumerate(zip(cands, means))]
    found = spark.createDataFrame(rows, "candidate int, params string, unmapped string, mean_auc double")
    # one row per candidate: a window over the candidate table is bounded
    found = found.withColumn("rank", F.rank().over(Window.orderBy(F.col("mean_auc").desc_nulls_last(), "candidate")))
    return found, cands[max(range(len(cands)), key=lambda i: (means[i] is not None, means[i] or 0.0, -i))]


def split_counts(model, columns: Sequence[str]) -> DataFrame:
    """ML17: number of splits that use each feature, over all trees, ranked.

    ``columns`` names the positions of the assembled vector (``feature_names``
    if some inputs are vectors).

    The fitted ensemble is written to the shared folder and its node table
    read back as a DataFrame; counting splits is then an ordinary
    aggregation.  (``featureImportances`` is gain based - another measure.)
    """
    gbt_model = model.stages[-1] if hasattr(model, "stages") else model
    if not isinstance(gbt_model, GBTClassificationModel):
        raise TypeError("expected a fitted GBT model or a pipeline ending in one")
    spark = SparkSession.getActiveSession()
    path = shared_path(spark, f"models/gbt-{uuid.uuid4().hex}")
    gbt_model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    used = nodes.where(F.col("nodeData.split.featureIndex") >= 0)
    counts = used.groupBy(F.col("nodeData.split.featureIndex").alias("feature_index")).agg(
        F.count(F.lit(1)).alias("splits"))
    names = spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "feature_index int, feature string")
    out = names.join(counts, "feature_index", "inner")
    w = Window.orderBy(F.col("splits").desc(), "feature")  # one row per feature
    return out.select("feature", "splits", F.rank().over(w).alias("rank"))
