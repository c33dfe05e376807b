"""Training: read, sample, spread, fit, save, log."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from flowscore.operators.sampling import bernoulli_sample, fold_number, repartition_dataset
from flowscore.plans.setups import load_setup, make_evaluator, setup_columns, setup_kind
from flowscore.sinks import append_csv
from flowscore.sources.datasets import dataset_name, read_dataset
from flowscore.sources.schemas import as_schema

# The column that tells the folds of a cross-validation.
FOLD = "__fold"

LOG_SCHEMA = StructType(
    [
        StructField("cores", IntegerType()),
        StructField("setup", StringType()),
        StructField("dataset", StringType()),
        StructField("model", StringType()),
        StructField("train_ratio", DoubleType()),
        StructField("training_time", DoubleType()),
    ]
)
SWEEP_SCHEMA = StructType([*LOG_SCHEMA.fields, StructField("partitions", IntegerType())])
# What tells one run of a sweep from another.
RUN_KEY = ["setup", "dataset", "cores", "partitions", "train_ratio"]


def configure_cross_validator(
    validator: CrossValidator,
    metric: str = "accuracy",
    metric_label: float = 1.0,
    folds: int = 2,
    parallelism: int | None = None,
) -> CrossValidator:
    """Set metric, folds and the number of fits that run at a time.

    ``parallelism`` defaults to the session's default parallelism. At least two
    folds are needed: with one, nothing is left to train on.
    """
    if folds < 2:
        raise ValueError(f"cross-validation needs 2 folds or more, not {folds}")
    if parallelism is None:
        parallelism = SparkSession.active().sparkContext.defaultParallelism
    evaluator = make_evaluator(metric, setup_columns(validator), metric_label)
    return (
        validator.copy().setNumFolds(folds).setParallelism(parallelism).setEvaluator(evaluator)
    )


def prepare_training_data(
    df: DataFrame, train_ratio: float = 1.0, partitions: int | None = None, seed: int = 42
) -> DataFrame:
    """Sample, then spread over the executors. A ratio of 1 keeps every row."""
    sampled = df if train_ratio >= 1.0 else bernoulli_sample(df, train_ratio, seed)
    return repartition_dataset(sampled, partitions)


def fit_setup(setup: Pipeline | CrossValidator, df: DataFrame) -> PipelineModel:
    """Fit; of a cross-validation, the best model refitted on all of ``df``.

    The data is kept while fitting, since every iteration reads it again.
    A table that the caller keeps already stays kept.
    """
    level = df.storageLevel
    own = not (level.useMemory or level.useDisk)
    if own:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = setup.fit(df)
    finally:
        if own:
            df.unpersist()
    return model.bestModel if isinstance(setup, CrossValidator) else model


def _log_row(spark: SparkSession, *values) -> DataFrame:
    cores = spark.sparkContext.defaultParallelism
    return spark.createDataFrame([(cores, *values)], LOG_SCHEMA)


def train(
    spark: SparkSession,
    setup: str | Pipeline | CrossValidator,
    dataset: str | DataFrame,
    output: str | None = None,
    kind: str = "pipeline",
    schema: str | StructType | None = None,
    train_ratio: float = 1.0,
    partitions: int | None = None,
    seed: int = 42,
    log: str | None = None,
    metric: str = "accuracy",
    metric_label: float = 1.0,
    folds: int = 2,
    parallelism: int | None = None,
    fold_keys: str | Sequence[str] | None = None,
    names: Mapping[str, str] | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Fit a setup on a dataset; returns the model and its one-row log.

    Setup and dataset are paths, or objects, which the log then calls by
    ``names["setup"]`` and ``names["dataset"]``; ``schema`` is a struct or the
    path of a schema file. With ``fold_keys`` a row's fold hangs on these columns
    and ``seed`` only, not on the partitions. ``output`` and ``log`` are
    written when given; an existing model is replaced, a log is added to.
    """
    names = dict(names or {})
    if isinstance(setup, str):
        names.setdefault("setup", dataset_name(setup))
        setup = load_setup(setup, kind)
    if isinstance(dataset, str):
        names.setdefault("dataset", dataset_name(dataset))
        dataset = read_dataset(spark, dataset, as_schema(spark, schema))
    if output is not None:
        names.setdefault("model", dataset_name(output))
    if setup_kind(setup) == "cross-validator":
        setup = configure_cross_validator(setup, metric, metric_label, folds, parallelism)
        if fold_keys is not None:
            if FOLD in dataset.columns:
                raise ValueError(f"input column {FOLD!r} is also the column of the folds")
            dataset = dataset.withColumn(FOLD, fold_number(fold_keys, folds, seed))
            setup = setup.setFoldCol(FOLD)

    data = prepare_training_data(dataset, train_ratio, partitions, seed)
    start = time.perf_counter()
    model = fit_setup(setup, data)
    seconds = time.perf_counter() - start

    if output is not None:
        model.write().overwrite().save(output)
    report = _log_row(
        spark,
        names.get("setup"),
        names.get("dataset"),
        names.get("model"),
        float(train_ratio),
        seconds,
    )
    if log is not None:
        append_csv(report, log)
    return model, report


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The runs of a manifest of ``training_sweep``; none if there is no such folder yet.

    Of runs under one key, which only sessions at the same time leave, the
    fastest counts.
    """
    try:
        found = spark.read.schema(SWEEP_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SWEEP_SCHEMA)
    rest = [c for c in SWEEP_SCHEMA.names if c not in RUN_KEY]
    best = F.min_by(F.struct(*rest), "training_time").alias("run")
    return found.groupBy(*RUN_KEY).agg(best).select(*RUN_KEY, "run.*").select(*SWEEP_SCHEMA.names)


def training_sweep(
    spark: SparkSession,
    setups: Mapping[str, Pipeline | CrossValidator],
    datasets: Mapping[str, str | DataFrame],
    partitions: Sequence[int | None] = (None,),
    manifest: str | None = None,
    **options,
) -> DataFrame:
    """Training time of every setup on every dataset at every partition count.

    The runs follow one another, each with the whole cluster, so that their
    times can be compared; ``cores`` is the session's, ``partitions`` is added.

    ``manifest`` is a folder to which every run is added as it ends. Runs found
    in it under the same setup, dataset, cores, partitions and ratio are not done
    again, so a sweep that broke off goes on, and sessions of other sizes add
    theirs. The result then holds all runs of the manifest.
    """
    cores = spark.sparkContext.defaultParallelism
    ratio = float(options.get("train_ratio", 1.0))
    done = set()
    if manifest is not None:
        done = {tuple(r) for r in read_manifest(spark, manifest).select(*RUN_KEY).collect()}
    rows = []
    for dataset_key, dataset in datasets.items():
        for setup_key, setup in setups.items():
            for count in partitions:
                if (setup_key, dataset_key, cores, count, ratio) in done:
                    continue
                names = {
                    "setup": setup_key,
                    "dataset": dataset_key,
                    "model": f"{setup_key}_{dataset_key}",
                }
                _, report = train(
                    spark, setup, dataset, partitions=count, names=names, **options
                )
                rows.append((*report.first(), count))
                if manifest is not None:
                    run = spark.createDataFrame(rows[-1:], SWEEP_SCHEMA).coalesce(1)
                    run.write.mode("append").parquet(manifest)
    if manifest is not None:
        return read_manifest(spark, manifest)
    return spark.createDataFrame(rows, SWEEP_SCHEMA)
