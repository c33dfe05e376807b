"""Members that several ensembles share, samples by content, folds by key."""

import pytest
from pyspark.sql import functions as F

import workload as w
from conftest import plan_of
from flowscore.operators import sampling
from flowscore.operators.ensemble import MODES, VotingEnsemble
from flowscore.plans import evaluation, setups, training


def test_members_are_applied_once_whoever_asks_them(spark, data):
    flows = w.shared_flows(spark, data)
    members = w.shared_models()
    ensembles = {
        mode: VotingEnsemble(list(members.values()), mode=mode, labelCol=w.LABEL, numClasses=2)
        for mode in MODES
    }
    nested = VotingEnsemble(
        [ensembles["attack"], ensembles["normal"], members["x_rule"]], mode="majority", labelCol=w.LABEL, numClasses=2
    )
    models = {**members, **ensembles, "nested": nested}
    result = evaluation.evaluate(spark, flows, models, label=w.LABEL)
    optimized = result._jdf.queryExecution().optimizedPlan().toString()
    for threshold in ("> 25", "> 0.05", ">= 0.04"):
        assert optimized.count(f"{threshold}") <= 2 * len(flows)
    together = {(r.Dataset, r.Model): tuple(r)[2:] for r in result.collect()}
    for name, model in models.items():
        for row in evaluation.evaluate(spark, flows, {name: model}, label=w.LABEL).collect():
            assert together[row.Dataset, name] == tuple(row)[2:]
    several = evaluation.evaluate(spark, flows, members, ensemble=MODES, label=w.LABEL, num_classes=2)
    assert {r.Model for r in several.collect()} == {f"{mode}(x_rule/y_rule/z_rule)" for mode in MODES}


def test_an_ensembles_label_must_be_in_the_data(spark):
    df = spark.range(5).withColumn("x", F.lit(1.0))
    model = VotingEnsemble([w.rule_model("x > 0")], labelCol="gone", numClasses=2)
    with pytest.raises(ValueError, match="'gone'"):
        evaluation.evaluate(spark, {"d": df}, {"m": model})


def counts(df):
    return {tuple(r)[:-1]: r["count"] for r in df.groupBy(*df.columns).count().collect()}


def test_content_sample_does_not_hang_on_partitions_and_draws_equal_rows_apart(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("IF(id < 12000, 0, id) AS key", "CAST(NULL AS STRING) AS none")
    one = counts(sampling.content_sample(rows, 0.25, seed=3))
    assert one == counts(sampling.content_sample(rows.repartition(11), 0.25, seed=3))
    assert one != counts(sampling.content_sample(rows, 0.25, seed=4))
    assert abs(one[0, None] / 12_000 - 0.25) < 0.02
    assert abs((sum(one.values()) - one[0, None]) / 8_000 - 0.25) < 0.03
    monkeypatch.setattr(sampling, "COPIES_A_BLOCK", 1000)
    assert one == counts(sampling.content_sample(rows, 0.25, seed=3))
    assert sampling.content_sample(rows, 1.0).count() == 20_000
    assert sampling.content_sample(rows, 0.0).count() == 0
    assert sampling.content_sample(rows.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        sampling.content_sample(rows, 1.5)


def test_folds_hang_on_the_key(spark, data):
    flows = w.planted_flows(spark, data)
    fold = sampling.fold_number("vec_id", 4)
    one = {r.vec_id: r.f for r in flows.select("vec_id", fold.alias("f")).collect()}
    assert one == {r.vec_id: r.f for r in flows.repartition(3).select("vec_id", fold.alias("f")).collect()}
    assert set(one.values()) == {0, 1, 2, 3}
    with pytest.raises(ValueError, match="folds"):
        sampling.fold_number("vec_id", 1)


def test_cross_validation_by_key_is_the_same_after_a_repartition(spark, data):
    flows = w.planted_flows(spark, data)
    setup = setups.build_setup("DT", ["noise"], w.LABEL, num_features=1, grid={"maxDepth": [1, 2]})
    found = []
    for table in (flows, flows.repartition(5)):
        data_of = training.prepare_training_data(table, partitions=1)
        chosen = training.configure_cross_validator(setup, "accuracy", folds=3)
        chosen = chosen.setFoldCol(training.FOLD)
        folded = data_of.withColumn(training.FOLD, sampling.fold_number("vec_id", 3))
        found.append(chosen.fit(folded.orderBy("vec_id")).avgMetrics)
    assert found[0] == found[1]
    model, _ = training.train(spark, setup, flows, folds=3, fold_keys=["vec_id"])
    assert training.FOLD not in model.transform(flows).columns
    with pytest.raises(ValueError, match="folds"):
        training.train(spark, setup, flows.withColumn(training.FOLD, F.lit(0)), fold_keys="vec_id")
