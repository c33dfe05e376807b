import itertools

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

import workload as w
from conftest import plan_of
from flowscore.functions import votes as V
from flowscore.operators.ensemble import VotingEnsemble
from flowscore.operators.metrics import as_vector
from flowscore.plans.setups import build_setup

CASES = [
    ([0, 1], [1, 1], [0.5, 0.5], 0, 1, 0),
    ([1, 1, 0], [1, 2], [1 / 3, 2 / 3], 1, 1, 0),
    ([0, 0], [2, 0], [1, 0], 0, 0, 0),
    ([1, 1], [0, 2], [0, 1], 1, 1, 1),
]


def column_models(count):
    return [w.rule_model(f"v{i}") for i in range(count)]


def vote_table(spark, rows):
    width = len(rows[0])
    return spark.createDataFrame(rows, ", ".join(f"v{i} DOUBLE" for i in range(width)))


def ensemble_of(count, **options):
    return VotingEnsemble(column_models(count), labelCol="y", numClasses=2, **options)


@pytest.mark.parametrize("votes,counts,shares,majority,attack,normal", CASES)
def test_vote_table(spark, votes, counts, shares, majority, attack, normal):
    df = vote_table(spark, [tuple(float(v) for v in votes)])
    expected = {"majority": majority, "attack": attack, "normal": normal}
    for mode, verdict in expected.items():
        row = ensemble_of(len(votes), mode=mode).transform(df).first()
        assert row.predictions == votes
        assert row.rawPrediction == counts
        assert row.probability == shares
        assert row.ensemble_prediction == verdict


def test_attack_majority_normal_are_ordered(spark):
    df = vote_table(spark, list(itertools.product([0.0, 1.0], repeat=4)))
    for mode in ("attack", "majority", "normal"):
        df = ensemble_of(
            4,
            mode=mode,
            predictionCol=mode,
            predictionsCol=f"{mode}_p",
            rawPredictionCol=f"{mode}_r",
            probabilityCol=f"{mode}_s",
        ).transform(df)
    assert df.filter("attack < majority OR majority < normal").count() == 0


def test_unrolled_and_wide_tallies_agree(spark, monkeypatch):
    rows = [(0.0, 2.0, 2.0), (1.0, None, 7.0), (None, None, None), (2.0, 1.0, 0.0)]
    df = vote_table(spark, rows)
    votes = ["v0", "v1", "v2"]

    def run():
        return df.select(
            V.vote_counts(votes, 3), V.vote_shares(votes, 3), V.majority_vote(votes, 3)
        ).collect()

    unrolled = [tuple(r) for r in run()]
    monkeypatch.setattr(V, "UNROLL_LIMIT", 0)
    assert [tuple(r) for r in run()] == unrolled
    assert unrolled[0] == ([1, 0, 2], [1 / 3, 0, 2 / 3], 2)
    assert unrolled[1] == ([0, 1, 0], [0, 1 / 3, 0], 1)
    assert unrolled[2] == ([0, 0, 0], [0, 0, 0], 0)


def test_null_votes_follow_three_valued_logic(spark):
    df = vote_table(spark, [(None, 1.0), (None, 0.0)])
    votes = ["v0", "v1"]
    rows = df.select(V.attack_vote(votes), V.normal_vote(votes)).collect()
    assert [tuple(r) for r in rows] == [(1.0, None), (None, 0.0)]


def test_votes_stay_in_codegen_without_shuffle(spark):
    df = spark.range(10).selectExpr("id % 2 + 0.0D AS v0", "id % 3 + 0.0D AS v1")
    plan = plan_of(ensemble_of(2).transform(df))
    assert "Exchange" not in plan and "Python" not in plan
    assert all(line.strip().startswith(("*(", "+- *(")) for line in plan.strip().splitlines())


def test_constructor_checks(spark):
    with pytest.raises(ValueError, match="mode"):
        ensemble_of(1, mode="median")
    with pytest.raises(ValueError, match="at least one"):
        VotingEnsemble().transform(spark.range(1))
    with pytest.raises(ValueError, match="numClasses"):
        VotingEnsemble(column_models(1)).transform(vote_table(spark, [(1.0,)]))
    assert ensemble_of(1, mode=None).getMode() == "majority"


def test_params_and_copy(spark):
    ensemble = ensemble_of(2, mode="normal", predictionCol="p", predictionsCol="ps")
    clone = ensemble.copy()
    for one in (ensemble, clone):
        assert one.getMode() == "normal"
        assert one.getPredictionCol() == "p"
        assert one.getPredictionsCol() == "ps"
        assert one.getRawPredictionCol() == "rawPrediction"
        assert one.getProbabilityCol() == "probability"
        assert one.getLabelCol() == "y"
        assert len(one.models) == 2
    changed = ensemble.copy({ensemble.mode: "attack"})
    assert (changed.getMode(), ensemble.getMode()) == ("attack", "normal")


def test_clashing_input_columns_raise(spark):
    df = vote_table(spark, [(1.0,)])
    with pytest.raises(ValueError, match="probability"):
        ensemble_of(1).transform(df.withColumn("probability", F.lit(1)))
    model = build_setup("LR", ["v0"], "y").fit(df.withColumn("y", F.lit(1.0)))
    with pytest.raises(ValueError, match="features"):
        VotingEnsemble([model]).transform(df.withColumn("features", F.lit(1)))


def test_fitted_members_share_column_names(spark, data):
    flows = w.embedding_flows(spark, data)
    members = [
        build_setup(family, ["vector"], w.LABEL).fit(flows) for family in ("DT", "LR")
    ]
    ensemble = VotingEnsemble(members, mode="attack")
    assert ensemble.getLabelCol() == w.LABEL
    assert ensemble.getNumClasses() == 2
    voted = ensemble.transform(flows)
    added = ["predictions", "rawPrediction", "probability", "ensemble_prediction"]
    assert voted.columns == flows.columns + added
    alone = [m.transform(flows).select("vec_id", "prediction").collect() for m in members]
    expected = {r.vec_id: [r.prediction] for r in alone[0]}
    for r in alone[1]:
        expected[r.vec_id].append(r.prediction)
    assert {r.vec_id: r.predictions for r in voted.collect()} == expected


def test_save_load_and_pipeline_use(spark, tmp_path):
    df = vote_table(spark, [(0.0, 1.0), (1.0, 1.0)])
    path = str(tmp_path / "ensemble")
    ensemble = ensemble_of(2, mode="normal")
    ensemble.save(path)
    ensemble.write().overwrite().save(path)
    loaded = VotingEnsemble.load(path)
    assert loaded.uid == ensemble.uid and loaded.getMode() == "normal"
    assert loaded.transform(df).collect() == ensemble.transform(df).collect()

    # The ensemble as a stage: usable in fit, and saved with the pipeline.
    after = SQLTransformer(statement="SELECT *, ensemble_prediction + 1 AS next FROM __THIS__")
    model = Pipeline(stages=[ensemble, after]).fit(df)
    assert sorted(r.next for r in model.transform(df).collect()) == [1.0, 2.0]
    model.save(str(tmp_path / "pipeline"))
    again = PipelineModel.load(str(tmp_path / "pipeline"))
    assert again.transform(df).collect() == model.transform(df).collect()
    assert ensemble.fit(df) is ensemble


def test_counts_as_vector_suit_the_mllib_evaluator(spark):
    df = vote_table(spark, [(0.0, 1.0), (1.0, 1.0), (0.0, 0.0)]).withColumn("y", F.col("v0"))
    voted = as_vector(ensemble_of(2).transform(df), "rawPrediction")
    assert BinaryClassificationEvaluator(labelCol="y").evaluate(voted) == 1.0


def test_ensemble_of_ensembles(spark):
    df = vote_table(spark, [(0.0, 1.0, 1.0), (1.0, 1.0, 1.0)])
    inner = [ensemble_of(3, mode=mode) for mode in ("normal", "attack", "majority")]
    voted = VotingEnsemble(inner, predictionsCol="modes", predictionCol="final", numClasses=2)
    assert [(r.modes, r.final) for r in voted.transform(df).collect()] == [
        ([0.0, 1.0, 1.0], 1.0),
        ([1.0, 1.0, 1.0], 1.0),
    ]
