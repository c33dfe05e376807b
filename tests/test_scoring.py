import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.sql import functions as F

import workload as w
from conftest import plan_of
from flowscore.operators.ensemble import VotingEnsemble
from flowscore.operators.scoring import keeps_rows, model_columns, predict_each
from flowscore.plans.evaluation import evaluate
from flowscore.plans.setups import build_setup


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(300).selectExpr("id", "id % 7 + 0D AS a", "id % 5 + 0D AS b", "id % 2 + 0D AS y")
    return df.cache()


@pytest.fixture(scope="module")
def models(table):
    return {f: build_setup(f, ["a", "b"], "y").fit(table) for f in ("DT", "LR", "RF")}


@pytest.mark.parametrize(
    "statement,plain",
    [
        ("SELECT *, a > 1 AS prediction FROM __THIS__", True),
        ("select *, a + b AS c,\n b AS d from __THIS__ ", True),
        ("SELECT *, a AS c FROM __THIS__ WHERE a > 1", False),
        ("SELECT *, explode(array(a, b)) AS c FROM __THIS__", False),
        ("SELECT *, (SELECT max(x) FROM t) AS c FROM __THIS__", False),
        ("SELECT a FROM __THIS__", False),
        ("SELECT DISTINCT * FROM __THIS__", False),
        ("SELECT *, a AS c FROM __THIS__ LIMIT 3", False),
        ("SELECT *, a AS c FROM __THIS__ UNION ALL SELECT *, 1 FROM __THIS__", False),
    ],
)
def test_sql_stages_that_keep_rows(spark, statement, plain):
    assert keeps_rows(PipelineModel([SQLTransformer(statement=statement)])) == plain


def test_stages_that_may_drop_rows(models):
    assert all(keeps_rows(model) for model in models.values())
    assert keeps_rows(VotingEnsemble(list(models.values())))
    skipping = VectorAssembler(inputCols=["a"], outputCol="f", handleInvalid="skip")
    assert not keeps_rows(PipelineModel([skipping]))
    assert not keeps_rows(VotingEnsemble([PipelineModel([skipping])], labelCol="y"))
    assert not keeps_rows(
        Bucketizer(splits=[0, 1, 2], inputCol="a", outputCol="prediction", handleInvalid="skip")
    )


def test_common_features_are_assembled_once(table, models):
    scored, predictions, labels = predict_each(table, list(models.values()), [None] * 3)
    assert scored.columns == [*table.columns, *predictions]
    assert labels == [None] * 3
    plan = plan_of(scored)
    assert plan.count("UDF(struct(") == 1
    for model, name in zip(models.values(), predictions):
        alone = {r.id: r.prediction for r in model.transform(table).collect()}
        assert {r["id"]: r[name] for r in scored.collect()} == alone


def test_different_features_are_not_mixed_up(table, models):
    other = build_setup("LR", ["b", "a"], "y").fit(table)
    pair = [models["DT"], other, models["RF"]]
    scored, predictions, _ = predict_each(table, pair, [None] * 3)
    assert plan_of(scored).count("UDF(struct(") == 2
    for model, name in zip(pair, predictions):
        alone = {r.id: r.prediction for r in model.transform(table).collect()}
        assert {r["id"]: r[name] for r in scored.collect()} == alone


def test_a_model_that_drops_rows_does_not_take_them_from_others(spark, table, models):
    holes = table.withColumn("b", F.when(F.col("id") % 3 > 0, F.col("b")))
    skipping = Pipeline(
        stages=[
            VectorAssembler(inputCols=["a", "b"], outputCol="f", handleInvalid="skip"),
            LogisticRegression(featuresCol="f", labelCol="y"),
        ]
    ).fit(table)
    rows = evaluate(
        spark, {"d": holes}, {"skips": skipping, "rule": w.rule_model("a > 2")}, label="y"
    ).collect()
    assert {r.Model: r.tp + r.tn + r.fp + r.fn for r in rows} == {"skips": 200, "rule": 300}


def test_model_columns_of_a_rule_are_the_defaults(spark):
    names = model_columns(w.rule_model("a > 1"))
    assert (names.label, names.prediction, names.probability) == (None, "prediction", None)
