import json

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import functions as F

import workload as w
from conftest import plan_of
from flowscore.operators import metrics as X
from flowscore.plans import evaluation
from flowscore.plans.evaluation import ensemble_name, evaluate


def test_grid_equals_one_metric_run_per_pair(spark, data):
    datasets, models = w.shared_flows(spark, data), w.shared_models()
    got = {
        (r.Dataset, r.Model): tuple(r)[2:]
        for r in evaluate(spark, datasets, models, label=w.LABEL).collect()
    }
    assert set(got) == {(d, m) for d in datasets for m in models}
    for (dataset, model), row in got.items():
        scored = models[model].transform(datasets[dataset])
        assert row == tuple(X.binary_metrics(scored, w.LABEL, "prediction").first())


def test_each_dataset_is_scanned_once(spark, data):
    datasets = w.shared_flows(spark, data)
    plan = plan_of(evaluate(spark, datasets, w.shared_models(), label=w.LABEL))
    assert plan.count("FileScan parquet") == len(datasets)
    assert plan.count("Exchange") == len(datasets)
    assert "Python" not in plan


def test_very_many_models_take_more_scans(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "MODELS_PER_SCAN", 2)
    df = spark.range(50).selectExpr("id % 5 + 0D AS x", "id % 2 + 0D AS y")
    models = {f"m{i}": w.rule_model(f"x > {i}") for i in range(5)}
    result = evaluate(spark, {"d": df}, models, label="y")
    assert plan_of(result).count("Range (0, 50") == 3
    assert {r.Model: r.tp + r.fp for r in result.collect()} == {
        f"m{i}": 40 - 10 * i for i in range(5)
    }


def test_ensembles_are_named_by_mode_and_members(spark, data):
    result = evaluate(
        spark, w.shared_flows(spark, data), w.shared_models(), "attack", label=w.LABEL,
        num_classes=2,
    )
    assert {r.Model for r in result.collect()} == {"attack(x_rule/y_rule/z_rule)"}
    assert ensemble_name("normal", ["a"]) == "normal(a)"


def test_paths_log_and_ratio(spark, tmp_path):
    df = spark.range(500).selectExpr("id % 5 + 0D AS x", "id % 2 + 0D AS y")
    paths = []
    for name in ("one.parquet", "two.parquet"):
        paths.append(str(tmp_path / name))
        df.coalesce(1).write.parquet(paths[-1])
    models = []
    for name in ("a.model", "b.model"):
        stages = [VectorAssembler(inputCols=["x"], outputCol="f")]
        stages.append(LogisticRegression(featuresCol="f", labelCol="y", maxIter=2))
        models.append(str(tmp_path / name))
        Pipeline(stages=stages).fit(df).save(models[-1])
    log = str(tmp_path / "metrics")
    result = evaluate(spark, paths, models, test_ratio=0.5, log=log)
    rows = result.collect()
    assert {(r.Dataset, r.Model) for r in rows} == {
        (d, m) for d in ("one.parquet", "two.parquet") for m in ("a.model", "b.model")
    }
    sizes = {r.Dataset: r.tp + r.tn + r.fp + r.fn for r in rows}
    assert all(150 < size < 350 for size in sizes.values())
    with pytest.raises(Exception, match="(?i)exists"):
        evaluate(spark, paths, models, log=log)
    schema = tmp_path / "schema.json"
    schema.write_text(json.dumps(df.schema.jsonValue()))
    ensemble = evaluate(spark, paths, models, "majority", schema=str(schema)).collect()
    assert {r.Model for r in ensemble} == {"majority(a.model/b.model)"}


def test_label_made_by_the_models_own_pipeline(spark):
    df = spark.range(100).selectExpr("id % 5 + 0D AS x", "IF(id % 2 = 0, 'yes', 'no') AS answer")
    to_label = SQLTransformer(statement="SELECT *, IF(answer = 'yes', 1D, 0D) AS y FROM __THIS__")
    features = VectorAssembler(inputCols=["x"], outputCol="f")
    model = Pipeline(
        stages=[to_label, features, LogisticRegression(featuresCol="f", labelCol="y", maxIter=1)]
    ).fit(df)
    row = evaluate(spark, {"d": df}, {"m": model, "again": model}).first()
    assert row.tp + row.tn + row.fp + row.fn == 100


def test_missing_label_is_named(spark):
    df = spark.range(5).withColumn("x", F.lit(1.0))
    with pytest.raises(ValueError, match="does not name its label"):
        evaluate(spark, {"d": df}, {"m": w.rule_model("x > 0")})
    with pytest.raises(ValueError, match="'gone'"):
        evaluate(spark, {"d": df}, {"m": w.rule_model("x > 0")}, label="gone")


def test_empty_dataset(spark):
    df = spark.createDataFrame([], "x DOUBLE, y DOUBLE")
    row = evaluate(spark, {"d": df}, {"m": w.rule_model("x > 0")}, label="y").first()
    assert (row.tp, row.fn, row.Accuracy, row.Precision) == (0, 0, None, 0.0)
