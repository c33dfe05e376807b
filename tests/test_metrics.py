import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from conftest import plan_of
from flowscore.operators import metrics as X

ROWS = [(1.0, 1.0, 0.9), (1.0, 0.0, 0.4), (0.0, 0.0, 0.1), (0.0, 1.0, 0.6), (0.0, 0.0, 0.3)]

GOLDEN = {
    "f1": 0.6,
    "weightedFMeasure": 0.6,
    "accuracy": 0.6,
    "weightedPrecision": 0.6,
    "weightedRecall": 0.6,
    "weightedTruePositiveRate": 0.6,
    "weightedFalsePositiveRate": 0.4333333333,
    "truePositiveRateByLabel": 0.5,
    "recallByLabel": 0.5,
    "falsePositiveRateByLabel": 0.3333333333,
    "precisionByLabel": 0.5,
    "fMeasureByLabel": 0.5,
    "logLoss": 0.4799954878,
    "hammingLoss": 0.4,
}


@pytest.fixture(scope="module")
def five(spark):
    df = spark.createDataFrame(ROWS, "label DOUBLE, prediction DOUBLE, s DOUBLE")
    return df.withColumn("probability", F.array(1 - F.col("s"), F.col("s")))


def test_golden_metrics(five):
    row = X.class_metrics(five, "label", "prediction", "probability").first().asDict()
    assert set(row) == set(X.CLASS_METRICS) == set(GOLDEN)
    assert row == pytest.approx(GOLDEN, abs=1e-9)


@pytest.mark.parametrize("metric", X.CLASS_METRICS)
def test_agrees_with_mllib_on_many_classes(spark, metric):
    df = spark.range(400).select(
        (F.col("id") % 7 % 4).cast("double").alias("label"),
        (F.col("id") % 11 % 5).cast("double").alias("prediction"),
    )
    weights = [F.col("label") + F.col("prediction") * i + 1 for i in range(5)]
    total = sum(weights[1:], weights[0])
    df = df.withColumn("probability", F.array(*[weight / total for weight in weights]))
    evaluator = MulticlassClassificationEvaluator(metricName=metric, metricLabel=2.0)
    expected = evaluator.evaluate(X.as_vector(df, "probability"))
    ours = X.class_metrics(df, "label", "prediction", "probability", metric_label=2.0).first()
    assert ours[metric] == pytest.approx(expected, abs=1e-12)


def test_beta_and_vector_probability(five):
    vectors = five.withColumn("probability", array_to_vector("probability"))
    row = X.class_metrics(vectors, "label", "prediction", "probability", beta=2.0).first()
    for metric in ("weightedFMeasure", "fMeasureByLabel", "f1", "logLoss"):
        evaluator = MulticlassClassificationEvaluator(
            metricName=metric, metricLabel=1.0, beta=2.0
        )
        assert row[metric] == pytest.approx(evaluator.evaluate(vectors), abs=1e-12)


def test_groups_match_separate_runs(spark):
    df = spark.range(300).select(
        F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string")).alias("g"),
        (F.col("id") % 2).cast("double").alias("label"),
        (F.col("id") % 5 % 2).cast("double").alias("prediction"),
    )
    grouped = {r.g: r for r in X.class_metrics(df, "label", "prediction", by=["g"]).collect()}
    assert set(grouped) == {None, "1", "2"}
    for key, row in grouped.items():
        part = df.filter(F.col("g").eqNullSafe(F.lit(key)))
        alone = X.class_metrics(part, "label", "prediction").first()
        assert tuple(row)[1:] == pytest.approx(tuple(alone), nan_ok=True)


def test_undefined_metrics_are_null(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 0.0)], "label DOUBLE, prediction DOUBLE")
    row = X.class_metrics(df, "label", "prediction").first()
    assert row.weightedFalsePositiveRate is None  # no negative of class 0
    assert row.recallByLabel is None  # class 1 never occurs
    assert row.precisionByLabel == 0.0
    assert row.logLoss is None
    empty = X.class_metrics(df.limit(0), "label", "prediction").first()
    assert empty.accuracy is None


def test_confusion_and_ratios(five):
    assert tuple(X.binary_metrics(five, "label", "prediction").first()) == (
        1, 2, 1, 1, 0.6, 0.5, 0.5, 0.5,
    )
    counts = X.confusion_counts(five, "label", "prediction").collect()
    assert {r.actual_predicted: r["count"] for r in counts} == {"TP": 1, "TN": 2, "FP": 1, "FN": 1}


def test_unknown_rows_are_in_no_cell(spark):
    rows = [(1.0, 1.0), (None, 1.0), (1.0, None), (2.0, 1.0), (2.0, 2.0)]
    df = spark.createDataFrame(rows, "label DOUBLE, prediction DOUBLE")
    counts = X.confusion_counts(df, "label", "prediction").collect()
    assert {r.actual_predicted: r["count"] for r in counts} == {"TP": 1, "Unknown": 4}
    assert tuple(X.confusion_matrix(df, "label", "prediction").first()) == (1, 0, 0, 0)


def test_no_positive_prediction_and_empty_input(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0)], "label DOUBLE, prediction DOUBLE")
    row = X.binary_metrics(df, "label", "prediction").first()
    assert (row.Accuracy, row.Precision, row.Recall, row.F1) == (0.5, 0.0, 0.0, 0.0)
    row = X.binary_metrics(df.limit(0), "label", "prediction").first()
    assert (row.tp, row.Accuracy, row.Precision, row.F1) == (0, None, 0.0, 0.0)
    assert X.confusion_matrix(df, "label", "prediction").schema["tp"].dataType.typeName() == "long"


def test_cells_and_unknown_add_up(spark):
    df = spark.range(1000).select(
        F.expr("IF(id % 10 = 0, null, id % 3)").alias("label"),
        F.expr("IF(id % 7 = 0, null, id % 2)").alias("prediction"),
    )
    counts = X.confusion_counts(df, "label", "prediction").agg(F.sum("count")).first()[0]
    assert counts == 1000


def test_rows_are_reduced_before_the_shuffle(five):
    plan = plan_of(X.binary_metrics(five, "label", "prediction"))
    assert plan.count("Exchange") == 1
    assert plan.count("partial_count_if") + plan.count("partial_count") >= 1
    plan = plan_of(X.class_metrics(five, "label", "prediction", by=[]))
    assert "Python" not in plan
