import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
)
from pyspark.ml.feature import PCAModel
from pyspark.ml.tuning import CrossValidator

import workload as w
from flowscore.operators.metrics import CLASS_METRICS, RANKING_METRICS
from flowscore.operators.scoring import class_count, model_columns
from flowscore.plans import setups, training

SMALL = {
    "DT": {"maxDepth": 2},
    "GBT": {"maxIter": 2, "maxDepth": 2},
    "LR": {"maxIter": 5},
    "MLP": {"maxIter": 5},
    "RF": {"numTrees": 2, "maxDepth": 2},
}


@pytest.fixture(scope="module")
def flows(spark, data):
    df = w.embedding_flows(spark, data).cache()
    yield df
    df.unpersist()


def setup(family="LR", **options):
    return setups.build_setup(
        family, ["vector"], w.LABEL, num_features=64, **{**SMALL[family], **options}
    )


@pytest.mark.parametrize("family", sorted(setups.FAMILIES))
def test_every_family_fits_and_names_its_columns(flows, family):
    model = setup(family).fit(flows)
    names = model_columns(model)
    assert (names.label, names.prediction) == (w.LABEL, "prediction")
    assert (names.raw_prediction, names.probability) == ("rawPrediction", "probability")
    assert class_count(model) == 2
    assert model.transform(flows).filter("prediction IN (0, 1)").count() == flows.count()


def test_setup_saved_before_training_gives_the_same_model(spark, flows, data, tmp_path):
    path = str(tmp_path / "LR.setup")
    setup().save(path)
    dataset = str(tmp_path / "flows.parquet")
    flows.coalesce(1).write.parquet(dataset)
    output, log = str(tmp_path / "LR.model"), str(tmp_path / "log")
    for _ in range(2):  # the model is replaced, the log grows
        model, report = training.train(spark, path, dataset, output, log=log, partitions=3)
    row = report.first()
    cores = spark.sparkContext.defaultParallelism
    assert row[:5] == (cores, "LR.setup", "flows.parquet", "LR.model", 1.0)
    assert row.training_time > 0
    assert spark.read.csv(log, header=True, schema=training.LOG_SCHEMA).count() == 2
    loaded = PipelineModel.load(output)
    assert loaded.stages[-1].coefficients == model.stages[-1].coefficients


def test_cross_validator_setup(spark, flows, tmp_path):
    path = str(tmp_path / "CV.setup")
    setup("DT", grid={"maxDepth": [1, 3]}).save(path)
    loaded = setups.load_setup(path, "cross-validator")
    assert isinstance(loaded, CrossValidator)
    assert setups.setup_columns(loaded).label == w.LABEL
    chosen = training.configure_cross_validator(loaded, "areaUnderPR", folds=3, parallelism=2)
    assert (chosen.getNumFolds(), chosen.getParallelism()) == (3, 2)
    assert isinstance(chosen.getEvaluator(), BinaryClassificationEvaluator)
    model, _ = training.train(
        spark, path, flows, kind="cross-validator", metric="areaUnderPR", parallelism=2
    )
    assert isinstance(model, PipelineModel)
    assert model.stages[-1].getMaxDepth() in (1, 3)


def test_parallelism_default_and_fold_check(spark):
    validator = setup("DT", grid={"maxDepth": [1]})
    chosen = training.configure_cross_validator(validator)
    assert chosen.getParallelism() == spark.sparkContext.defaultParallelism
    for folds in (0, 1):
        with pytest.raises(ValueError, match="2 folds"):
            training.configure_cross_validator(validator, folds=folds)


def test_evaluator_choice(flows):
    names = model_columns(setup().fit(flows))
    smaller = {
        "weightedFalsePositiveRate", "falsePositiveRateByLabel", "logLoss", "hammingLoss",
    }
    for metric in RANKING_METRICS + CLASS_METRICS:
        evaluator = setups.make_evaluator(metric, names, metric_label=0.0)
        ranking = metric in RANKING_METRICS
        kind = BinaryClassificationEvaluator if ranking else MulticlassClassificationEvaluator
        assert isinstance(evaluator, kind)
        assert evaluator.getMetricName() == metric
        assert evaluator.getLabelCol() == w.LABEL
        assert evaluator.isLargerBetter() == (metric not in smaller)
        if not ranking:
            assert evaluator.getMetricLabel() == 0.0
    with pytest.raises(ValueError, match="rmse"):
        setups.make_evaluator("rmse", names)


def test_unknown_family_and_kind(spark):
    with pytest.raises(ValueError, match="SVM"):
        setups.build_setup("SVM", ["x"], "y")
    with pytest.raises(ValueError, match="kind"):
        setups.load_setup("nowhere", "forest")


def test_pca_and_plain_columns(spark):
    df = spark.range(60).selectExpr("id % 7 + 0D AS a", "id % 5 + 0D AS b", "id % 2 + 0D AS y")
    model = setups.build_setup("MLP", ["a", "b"], "y", pca_k=1, hidden=(3,), maxIter=2).fit(df)
    assert isinstance(model.stages[1], PCAModel)
    assert model.stages[-1].getLayers() == [1, 3, 2]
    assert len(model.transform(df).first().pca_features) == 1


def test_data_is_released_after_fitting(spark, data):
    df = w.embedding_flows(spark, data).filter("vec_id >= 0")
    model, _ = training.train(spark, setup(), df, train_ratio=0.5, partitions=2)
    assert isinstance(model, PipelineModel)
    prepared = training.prepare_training_data(df, 0.5, 2)
    assert not prepared.is_cached
    assert isinstance(training.fit_setup(setup(), prepared), PipelineModel)
    assert not prepared.is_cached


def test_sweep_logs_every_run(spark, flows):
    sweep = training.training_sweep(
        spark, {"DT": setup("DT"), "LR": setup()}, {"d": flows}, partitions=[2, 4], train_ratio=0.7
    )
    rows = sweep.collect()
    assert {(r.setup, r.dataset, r.partitions) for r in rows} == {
        (s, "d", p) for s in ("DT", "LR") for p in (2, 4)
    }
    assert all(r.training_time > 0 and r.train_ratio == 0.7 for r in rows)


def test_manifest_skips_what_is_done_and_takes_other_sessions(spark, flows, tmp_path, monkeypatch):
    path = str(tmp_path / "manifest")
    assert training.read_manifest(spark, path).count() == 0
    planned = {"DT": setup("DT")}
    options = {"partitions": [2, None], "manifest": path}
    first = training.training_sweep(spark, planned, {"e": flows}, **options).collect()
    assert sorted((r.partitions is None, r.cores) for r in first) == [(False, 8), (True, 8)]

    # A session of four cores did the same runs: they are others.
    four = [(4, *r[1:]) for r in first]
    four = spark.createDataFrame(four, training.SWEEP_SCHEMA)
    four.write.mode("append").parquet(path)

    def no_more(*args, **kwargs):
        raise AssertionError("a run was done again")

    monkeypatch.setattr(training, "train", no_more)
    again = training.training_sweep(spark, planned, {"e": flows}, **options)
    assert sorted(again.collect(), key=repr) == sorted([*first, *four.collect()], key=repr)
    with pytest.raises(AssertionError):
        training.training_sweep(spark, planned, {"e": flows}, train_ratio=0.5, **options)


def test_manifest_takes_the_faster_of_two_runs_at_the_same_time(spark, tmp_path):
    path = str(tmp_path / "manifest")
    runs = [(8, "DT", "e", "DT_e", 1.0, 3.0, None), (8, "DT", "e", "DT_e", 1.0, 2.0, None)]
    for run in runs:
        spark.createDataFrame([run], training.SWEEP_SCHEMA).write.mode("append").parquet(path)
    assert [tuple(r) for r in training.read_manifest(spark, path).collect()] == [runs[1]]


def test_pipeline_setup_kind(spark):
    assert setups.setup_kind(Pipeline(stages=[])) == "pipeline"
    assert setups.setup_kind(setup("DT", grid={"maxDepth": [1]})) == "cross-validator"
