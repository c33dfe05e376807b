"""Confusion matrices and model-selection metrics as distributed aggregates.

Everything about one scored table comes from one pass: rows are reduced on the
map side to a handful of counters, so a class or group that holds most of the
rows costs no more than any other. ``by`` gives one result row per group, e.g.
per dataset and model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from flowscore.functions import confusion as C
from flowscore.functions.confusion import share
from flowscore.functions.names import column, quote_all, quoted

# Metric names a cross-validation may select by.
RANKING_METRICS = ("areaUnderROC", "areaUnderPR")
CLASS_METRICS = (
    "f1",
    "accuracy",
    "weightedPrecision",
    "weightedRecall",
    "weightedTruePositiveRate",
    "weightedFalsePositiveRate",
    "weightedFMeasure",
    "truePositiveRateByLabel",
    "falsePositiveRateByLabel",
    "precisionByLabel",
    "recallByLabel",
    "fMeasureByLabel",
    "logLoss",
    "hammingLoss",
)

# Fixed value: probabilities are clipped to [EPSILON, 1 - EPSILON] in logLoss.
EPSILON = 1e-15


def as_vector(df: DataFrame, name: str) -> DataFrame:
    """Turn an array column into the vector MLlib evaluators ask for."""
    if isinstance(df.schema[name].dataType, ArrayType):
        return df.withColumn(name, array_to_vector(column(name)))
    return df


def as_array(df: DataFrame, name: str) -> Column:
    """The column as ``array<double>``, whether stored as array or vector."""
    if isinstance(df.schema[name].dataType, ArrayType):
        return column(name).cast("array<double>")
    return vector_to_array(column(name))


def batch_counts(df: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and positives, in one pass."""
    return df.groupBy(*quote_all(by)).agg(
        F.count("*").alias("events"), F.expr(f"count_if({quoted(target)} = 1) AS positives")
    )


def confusion_counts(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """One row per confusion class that occurs, ``Unknown`` included."""
    outcome = C.confusion_class(label, prediction).alias("actual_predicted")
    return df.groupBy(*quote_all(by), outcome).count()


def confusion_matrix(
    df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()
) -> DataFrame:
    """``tp tn fp fn`` in one row per group."""
    return df.groupBy(*quote_all(by)).agg(*C.cell_counts(label, prediction))


def add_binary_ratios(matrix: DataFrame) -> DataFrame:
    """Append ``Accuracy Precision Recall F1`` to ``tp tn fp fn``."""
    return matrix.selectExpr(
        "*",
        f"{C.ACCURACY} AS Accuracy",
        f"{C.PRECISION} AS Precision",
        f"{C.RECALL} AS Recall",
    ).selectExpr("*", f"{C.F_ONE} AS F1")


def binary_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix and the four ratios."""
    return add_binary_ratios(confusion_matrix(df, label, prediction, by))


def _cells(
    df: DataFrame, label: str, prediction: str, probability: str | None, by: Sequence[str]
) -> DataFrame:
    """One row per label and prediction: the only pass over the data."""
    pairs = df.select(
        *quote_all(by),
        column(label).cast("double").alias("__l"),
        column(prediction).cast("double").alias("__p"),
        *([] if probability is None else [as_array(df, probability).alias("__prob")]),
    )
    # A label without a probability of its own counts as probability 0.
    chance = "coalesce(get(__prob, TRY_CAST(__l AS INT)), 0D)"
    clipped = f"greatest({EPSILON}D, least(1D - {EPSILON}D, {chance}))"
    loss = "CAST(NULL AS DOUBLE)" if probability is None else f"sum(-ln({clipped}))"
    return pairs.groupBy(*quote_all(by), "__l", "__p").agg(
        F.count("*").alias("__n"), F.expr(f"{loss} AS __loss")
    )


def _classes(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per class: rows with that label (``support``), with that prediction
    (``claims``), with both (``hits``); and all rows of the group (``total``).

    A cell adds to the support of its label and to the claims of its prediction.
    """
    # Cells without label or prediction are dropped here, among few rows, by an
    # empty array. A filter would move down to the data and compute the
    # prediction a second time for every row.
    sides = """inline(IF(__l IS NULL OR __p IS NULL, array(), array(
        named_struct('class', __l, 'support', __n, 'hits', IF(__l = __p, __n, 0L), 'claims', 0L,
                     'loss', __loss),
        named_struct('class', __p, 'support', 0L, 'hits', 0L, 'claims', __n,
                     'loss', CAST(NULL AS DOUBLE)))))"""
    sums = [F.sum(name).alias(name) for name in ("support", "hits", "claims", "loss")]
    # One row per class and group is left here, so the window is small.
    whole = W.partitionBy(*quote_all(by))
    return (
        cells.selectExpr(*quote_all(by), sides)
        .groupBy(*quote_all(by), "class")
        .agg(*sums)
        .withColumn("total", F.sum("support").over(whole))
    )


def class_metrics(
    df: DataFrame,
    label: str,
    prediction: str,
    probability: str | None = None,
    by: Sequence[str] = (),
    metric_label: float = 1.0,
    beta: float = 1.0,
) -> DataFrame:
    """All metrics built on class counts, one column each, named as in MLlib.

    ``...ByLabel`` columns are about class ``metric_label`` and are null where
    the metric is undefined. ``logLoss`` needs ``probability``. Rows without a
    label or a prediction are left out.
    """

    def f_measure(weight: float) -> str:
        harmonic = share(f"{1 + weight}D * precision * recall", f"{weight}D * precision + recall")
        return f"CASE WHEN recall IS NOT NULL THEN {harmonic} END"

    rated = (
        _classes(_cells(df, label, prediction, probability, by), by)
        .selectExpr(
            "*",
            f"{share('hits', 'claims')} AS precision",
            f"{share('hits', 'support', empty='NULL')} AS recall",
            f"{share('claims - hits', 'total - support', empty='NULL')} AS fpr",
        )
        .selectExpr("*", f"{f_measure(1.0)} AS f1", f"{f_measure(beta * beta)} AS fb")
    )

    def weighted(rate: str) -> str:
        return f"sum(CASE WHEN support > 0 THEN {rate} * (support / total) END)"

    def of_label(rate: str) -> str:
        return f"max(CASE WHEN class = {float(metric_label)}D THEN {rate} END)"

    definitions = {
        "f1": weighted("f1"),
        "accuracy": "sum(hits) / max(total)",
        "weightedPrecision": weighted("precision"),
        "weightedRecall": weighted("recall"),
        "weightedTruePositiveRate": weighted("recall"),
        "weightedFalsePositiveRate": weighted("fpr"),
        "weightedFMeasure": weighted("fb"),
        "truePositiveRateByLabel": of_label("recall"),
        "falsePositiveRateByLabel": of_label("fpr"),
        "precisionByLabel": of_label("precision"),
        "recallByLabel": of_label("recall"),
        "fMeasureByLabel": of_label("fb"),
        "logLoss": "sum(loss) / max(total)",
        "hammingLoss": "(max(total) - sum(hits)) / max(total)",
    }
    return rated.groupBy(*quote_all(by)).agg(
        *[F.expr(text).alias(name) for name, text in definitions.items()]
    )
