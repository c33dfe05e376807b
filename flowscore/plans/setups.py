"""Untrained setups: what to fit, saved before training so a run can be repeated."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    Evaluator,
    MulticlassClassificationEvaluator,
)
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

from flowscore.operators.metrics import CLASS_METRICS, RANKING_METRICS
from flowscore.operators.scoring import ModelColumns, last_stage, model_columns

# Short names of the model families.
FAMILIES = {
    "DT": DecisionTreeClassifier,
    "GBT": GBTClassifier,
    "LR": LogisticRegression,
    "MLP": MultilayerPerceptronClassifier,
    "RF": RandomForestClassifier,
}

KINDS = ("pipeline", "cross-validator")


def build_setup(
    family: str,
    features: Sequence[str],
    label: str,
    pca_k: int | None = None,
    grid: Mapping[str, Sequence] | None = None,
    num_features: int | None = None,
    hidden: Sequence[int] = (16,),
    num_classes: int = 2,
    seed: int = 42,
    **params,
) -> Pipeline | CrossValidator:
    """Assemble ``features``, optionally reduce them, classify.

    With ``grid`` (classifier parameter name to values) the result is a
    cross-validator over the pipeline. ``num_features`` is the width of the
    assembled vector, needed by MLP when a feature column is itself a vector.
    """
    if family not in FAMILIES:
        raise ValueError(f"family {family!r} is not one of {sorted(FAMILIES)}")
    stages: list = [VectorAssembler(inputCols=list(features), outputCol="features")]
    inputs = "features"
    if pca_k is not None:
        stages.append(PCA(k=pca_k, inputCol="features", outputCol="pca_features"))
        inputs = "pca_features"

    settings = {"featuresCol": inputs, "labelCol": label, **params}
    if family == "MLP":
        width = pca_k or num_features or len(features)
        settings.setdefault("layers", [width, *hidden, num_classes])
    if family != "LR":
        settings.setdefault("seed", seed)
    classifier = FAMILIES[family](**settings)
    pipeline = Pipeline(stages=[*stages, classifier])
    if not grid:
        return pipeline

    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(classifier.getParam(name), list(values))
    # The evaluator is a placeholder a training run replaces by its own metric.
    return CrossValidator(
        estimator=pipeline,
        estimatorParamMaps=builder.build(),
        evaluator=make_evaluator("accuracy", model_columns(pipeline)),
        seed=seed,
    )


def setup_kind(setup: Estimator) -> str:
    return "cross-validator" if isinstance(setup, CrossValidator) else "pipeline"


def load_setup(path: str, kind: str) -> Pipeline | CrossValidator:
    if kind not in KINDS:
        raise ValueError(f"setup kind {kind!r} is not one of {KINDS}")
    return CrossValidator.load(path) if kind == "cross-validator" else Pipeline.load(path)


def setup_columns(setup: Estimator) -> ModelColumns:
    """Columns of the classifier inside a pipeline or cross-validator."""
    inner = setup.getEstimator() if isinstance(setup, CrossValidator) else setup
    return model_columns(last_stage(inner))


def make_evaluator(metric: str, names: ModelColumns, metric_label: float = 1.0) -> Evaluator:
    """MLlib evaluator for a metric name; knows for itself which way is better."""
    if metric in RANKING_METRICS:
        return BinaryClassificationEvaluator(
            labelCol=names.label,
            rawPredictionCol=names.raw_prediction or "rawPrediction",
            metricName=metric,
        )
    if metric not in CLASS_METRICS:
        raise ValueError(f"metric {metric!r} is not one of {RANKING_METRICS + CLASS_METRICS}")
    return MulticlassClassificationEvaluator(
        labelCol=names.label,
        predictionCol=names.prediction,
        probabilityCol=names.probability or "probability",
        metricName=metric,
        metricLabel=metric_label,
    )
