"""Applying one or several fitted models to a table or stream.

Nothing here shuffles: a model is a projection, several models are a chain of
projections over one scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame

from flowscore.functions.names import column, quote_all

# A SQL stage that only adds columns, unless one of them makes or merges rows.
ADDS_COLUMNS = re.compile(r"SELECT\s+\*\s*,(.*)\bFROM\s+__THIS__", re.IGNORECASE | re.DOTALL)
CHANGES_ROWS = re.compile(
    r"\b(FROM|WHERE|(POS)?EXPLODE(_OUTER)?|INLINE(_OUTER)?|STACK|JSON_TUPLE)\b", re.IGNORECASE
)


@dataclass(frozen=True)
class ModelColumns:
    """Column names a model works with; what it does not have is ``None``."""

    label: str | None
    prediction: str
    raw_prediction: str | None
    probability: str | None


def last_stage(model):
    """The classifier of a pipeline (fitted or not), or the model itself."""
    # On an unfitted pipeline ``stages`` is the parameter, not its value.
    stages = model.getStages() if hasattr(model, "getStages") else getattr(model, "stages", None)
    return stages[-1] if stages else model


def _ask(stage, getter: str) -> str | None:
    method = getattr(stage, getter, None)
    return method() if callable(method) else None


def model_columns(model) -> ModelColumns:
    """Ask the last stage.

    A stage without the getter (a rule written as a SQL projection) is taken to
    follow the MLlib default, a column named ``prediction``.
    """
    stage = last_stage(model)
    return ModelColumns(
        label=_ask(stage, "getLabelCol"),
        prediction=_ask(stage, "getPredictionCol") or "prediction",
        raw_prediction=_ask(stage, "getRawPredictionCol"),
        probability=_ask(stage, "getProbabilityCol"),
    )


def class_count(model) -> int | None:
    return getattr(last_stage(model), "numClasses", None)


def score(df: DataFrame, model: Transformer) -> DataFrame:
    """Input columns plus what the model adds."""
    return model.transform(df)


def _added_columns(model) -> set[str]:
    getters = ("getOutputCol", "getPredictionCol", "getRawPredictionCol", "getProbabilityCol")
    names: set[str] = set()
    for stage in getattr(model, "stages", [model]):
        # Only output columns the stage really sets: several have unset params.
        for getter in getters:
            try:
                names.add(_ask(stage, getter))
            except KeyError:
                continue
    return names - {None, ""}


def keeps_rows(model) -> bool:
    """Whether the model gives exactly one row per input row.

    MLlib's stages do, unless told to skip invalid rows; a SQL stage does if it
    only adds expressions; stages of other origin are not trusted to.
    """
    if hasattr(model, "models"):
        return all(keeps_rows(member) for member in model.models)
    for stage in getattr(model, "stages", [model]):
        if hasattr(stage, "models") or hasattr(stage, "stages"):
            if not keeps_rows(stage):
                return False
        elif isinstance(stage, SQLTransformer):
            added = ADDS_COLUMNS.fullmatch(stage.getStatement().strip())
            if added is None or CHANGES_ROWS.search(added[1]):
                return False
        elif not type(stage).__module__.startswith("pyspark.ml."):
            return False
        elif stage.hasParam("handleInvalid") and stage.getOrDefault("handleInvalid") == "skip":
            return False
    return True


def _assembly(model, inputs: Sequence[str]) -> tuple | None:
    """What the model's first stage assembles, if it is taken from the input only."""
    stages = getattr(model, "stages", [])
    if len(stages) < 2 or not isinstance(stages[0], VectorAssembler):
        return None
    names = tuple(stages[0].getInputCols())
    return (names, stages[0].getHandleInvalid()) if set(names) <= set(inputs) else None


def predict_each(
    df: DataFrame, models: Sequence[Transformer], labels: Sequence[str | None]
) -> tuple[DataFrame, list[str], list[str | None]]:
    """One scan, one prediction column per model.

    Each model's intermediate columns are dropped before the next one runs, so
    models may share names. Feature vectors that several models assemble from
    the same columns are assembled once. A row one model drops is missing for
    all, see ``keeps_rows``.

    Returns the table and, per model, the names of its prediction column and of
    its label column. A label that only the model's own pipeline produces is
    kept in a column of its own.
    """
    inputs = df.columns
    for number, model in enumerate(models):
        clash = sorted(_added_columns(model).intersection(inputs))
        if clash:
            raise ValueError(f"input columns {clash} are also outputs of model {number}")

    # A member may be an ensemble itself and find the outer one's columns here.
    prefix = "__"
    while any(name.startswith(prefix) for name in inputs):
        prefix += "_"

    scored, assembled = df, {}
    assemblies = [_assembly(model, inputs) for model in models]
    for model, key in zip(models, assemblies, strict=True):
        if key is not None and key not in assembled and assemblies.count(key) > 1:
            assembled[key] = f"{prefix}features_{len(assembled)}"
            first = model.stages[0]
            scored = first.copy({first.outputCol: assembled[key]}).transform(scored)

    kept, predictions, label_names = quote_all(scored.columns), [], []
    for number, (model, key, label) in enumerate(zip(models, assemblies, labels, strict=True)):
        if key in assembled:
            vector = column(assembled[key])
            start = scored.withColumn(model.stages[0].getOutputCol(), vector)
            output = PipelineModel(model.stages[1:]).transform(start)
        else:
            output = model.transform(scored)
        predictions.append(f"{prefix}prediction_{number}")
        new = [column(model_columns(model).prediction).alias(predictions[-1])]
        if label is not None and label not in inputs:
            if label not in output.columns:
                raise ValueError(f"label column {label!r} of model {number} is not in the data")
            new.append(column(label).alias(f"{prefix}label_{number}"))
            label = f"{prefix}label_{number}"
        label_names.append(label)
        scored = output.select(*kept, *new)
        kept += [predictions[-1]] if len(new) == 1 else [predictions[-1], label]
    return scored.drop(*assembled.values()), predictions, label_names
