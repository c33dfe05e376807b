"""Evaluation of every model on every dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowscore.functions.confusion import cell_counts
from flowscore.operators.ensemble import VotingEnsemble
from flowscore.operators.metrics import add_binary_ratios
from flowscore.operators.sampling import bernoulli_sample
from flowscore.operators.scoring import keeps_rows, model_columns, predict_each
from flowscore.sinks import write_csv
from flowscore.sources.datasets import dataset_name, read_dataset
from flowscore.sources.schemas import as_schema

Datasets = Mapping[str, DataFrame] | Sequence[str]
Models = Mapping[str, Transformer] | Sequence[str]

RESULT_SCHEMA = (
    "Dataset STRING, Model STRING, tp BIGINT, tn BIGINT, fp BIGINT, fn BIGINT, "
    "Accuracy DOUBLE, Precision DOUBLE, Recall DOUBLE, F1 DOUBLE"
)

# Four counters a model: beyond this the generated aggregation code is too long
# for the JVM to compile, and a second scan is cheaper.
MODELS_PER_SCAN = 24


def _label_of(model: Transformer) -> str:
    label = model_columns(model).label
    if label is None:
        raise ValueError("the model does not name its label column; pass label")
    return label


def _distinct_members(models: Sequence[Transformer]) -> list[Transformer]:
    """The models that ensembles, and ensembles of them, ask in the end: each object once."""
    out: dict[int, Transformer] = {}
    for model in models:
        inner = _distinct_members(model.models) if isinstance(model, VotingEnsemble) else [model]
        out.update((id(member), member) for member in inner)
    return list(out.values())


def _predict_shared(
    df: DataFrame, models: Sequence[Transformer], labels: Sequence[str]
) -> tuple[DataFrame, list[str], list[str]]:
    """``predict_each`` where each member is applied once, whoever asks it.

    Single models are members like others; an ensemble is an expression over the
    votes of its members.
    """
    if not any(isinstance(model, VotingEnsemble) for model in models):
        return predict_each(df, models, labels)
    members = _distinct_members(models)
    own = {id(model): label for model, label in zip(models, labels, strict=True)}
    asked = [own.get(id(member)) for member in members]
    scored, predictions, found = predict_each(df, members, asked)
    votes = {id(member): name for member, name in zip(members, predictions, strict=True)}
    label_of = {id(member): name for member, name in zip(members, found, strict=True)}

    def vote(model: Transformer) -> str:
        nonlocal scored
        if id(model) not in votes:
            ballots = [vote(member) for member in model.models]
            name = f"{max(predictions, key=len)}_{len(votes)}"
            scored = scored.withColumn(name, model.verdict(ballots))
            votes[id(model)] = name
        return votes[id(model)]

    names = [vote(model) for model in models]
    for label, model in zip(labels, models, strict=True):
        if id(model) not in label_of and label not in df.columns:
            raise ValueError(f"label column {label!r} of an ensemble is not in the data")
    shown = [label_of.get(id(m)) or label for m, label in zip(models, labels, strict=True)]
    return scored, names, shown


def _matrices_of(
    name: str, df: DataFrame, models: Sequence[tuple[str, Transformer]], label: str | None
) -> DataFrame:
    """One row per model: the models are applied and counted in one scan of ``df``."""
    labels = [label or _label_of(model) for _, model in models]
    scored, predictions, label_names = _predict_shared(df, [m for _, m in models], labels)
    rows = [
        F.struct(
            F.lit(name).alias("Dataset"),
            F.lit(model_name).alias("Model"),
            *cell_counts(label_name, prediction),
        )
        for (model_name, _), prediction, label_name in zip(
            models, predictions, label_names, strict=True
        )
    ]
    return scored.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def evaluate_tables(
    datasets: Sequence[tuple[str, DataFrame]],
    models: Sequence[tuple[str, Transformer]],
    label: str | None = None,
) -> DataFrame:
    """Confusion counts and ratios per (dataset, model), lazily, in one query.

    Reads each dataset once for up to ``MODELS_PER_SCAN`` models and shuffles
    one row of counters per task. A model that several ensembles have as a member,
    or that is evaluated beside them, is applied once a scan. A model that may drop rows gets a scan of its
    own, so that it does not take them from the others. ``label`` overrides what
    the models say.
    """
    safe = [(name, model) for name, model in models if keeps_rows(model)]
    together = [safe[i : i + MODELS_PER_SCAN] for i in range(0, len(safe), MODELS_PER_SCAN)]
    alone = [[(name, model)] for name, model in models if not keeps_rows(model)]
    parts = [
        _matrices_of(name, df, group, label)
        for name, df in datasets
        for group in [*together, *alone]
    ]
    return add_binary_ratios(reduce(DataFrame.unionByName, parts))


def ensemble_name(mode: str, member_names: Sequence[str]) -> str:
    return f"{mode}({'/'.join(member_names)})"


def _named_datasets(
    spark: SparkSession, datasets: Datasets, schema: StructType | None
) -> list[tuple[str, DataFrame]]:
    if isinstance(datasets, Mapping):
        return list(datasets.items())
    return [(dataset_name(path), read_dataset(spark, path, schema)) for path in datasets]


def _named_models(models: Models) -> list[tuple[str, Transformer]]:
    if isinstance(models, Mapping):
        return list(models.items())
    return [(dataset_name(path), PipelineModel.load(path)) for path in models]


def evaluate(
    spark: SparkSession,
    datasets: Datasets,
    models: Models,
    ensemble: str | Sequence[str] | None = None,
    schema: str | StructType | None = None,
    test_ratio: float = 1.0,
    seed: int = 42,
    log: str | None = None,
    label: str | None = None,
    num_classes: int | None = None,
) -> DataFrame:
    """Evaluate models, or one ensemble of all of them, on each dataset.

    Datasets and models are paths, or mappings from name to object; ``schema``
    is a struct or the path of a schema file, for datasets given as paths. With
    ``ensemble`` (a voting mode, or several) there is one row per dataset and
    mode, under the name ``mode(model/model/...)``. ``log`` is a new csv folder for the result.
    """
    tables = _named_datasets(spark, datasets, as_schema(spark, schema))
    if test_ratio < 1.0:
        tables = [(name, bernoulli_sample(df, test_ratio, seed)) for name, df in tables]
    named = _named_models(models)
    if ensemble is not None:
        modes = [ensemble] if isinstance(ensemble, str) else list(ensemble)
        members, names = [model for _, model in named], [name for name, _ in named]
        named = [
            (
                ensemble_name(mode, names),
                VotingEnsemble(members, mode=mode, labelCol=label, numClasses=num_classes),
            )
            for mode in modes
        ]
    result = evaluate_tables(tables, named, label)
    if log is None:
        return result
    write_csv(result, log)
    return spark.read.schema(RESULT_SCHEMA).csv(log, header=True)
