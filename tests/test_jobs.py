import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

import workload as w
from flowscore.operators.ensemble import VotingEnsemble
from flowscore.plans.setups import build_setup
from flowscore.sinks import text_sink
from flowscore.streaming import jobs
from flowscore.streaming.scoring import read_report


@pytest.fixture(scope="module")
def files(spark, data, tmp_path_factory):
    """Schema file, dataset and two fitted models on disk."""
    folder = tmp_path_factory.mktemp("files")
    flows = w.event_flows(spark, data).select("event_id", "user_id", "value", "k", w.LABEL)
    schema = flows.schema.jsonValue()
    for field in schema["fields"]:
        field["nullable"] = field["name"] not in ("event_id", "value")
    (folder / "schema.json").write_text(json.dumps(schema, indent=1))
    flows.write.parquet(str(folder / "flows.parquet"))
    for family in ("DT", "LR"):
        build_setup(family, ["value", "k"], w.LABEL).fit(flows).save(str(folder / family))
    return folder


def test_one_model_or_an_ensemble(files):
    paths = [str(files / "DT"), str(files / "LR")]
    assert isinstance(jobs.load_models(paths[:1]), PipelineModel)
    assert jobs.load_models(paths).getMode() == "majority"
    assert jobs.load_models(paths, "normal").getMode() == "normal"
    assert isinstance(jobs.load_models(paths[:1], "attack"), VotingEnsemble)


def test_replay_then_score(spark, files, tmp_path, monkeypatch):
    """Without a broker, a folder of text lines stands in for the topic."""
    topic = str(tmp_path / "topic")
    monkeypatch.setattr(jobs, "topic_sink", lambda brokers, name: text_sink(topic))
    sent = jobs.replay_to_topic(
        spark,
        str(files / "flows.parquet"),
        str(files / "schema.json"),
        ["broker:9092"],
        "flows",
        rows=400,
        order_by=["event_id"],
        batches=3,
        delay=0,
    )
    assert [r.events for r in sent.orderBy("batch_no").collect()] == [400, 400, 200]

    monkeypatch.setattr(
        jobs, "read_topic", lambda spark, brokers, name, **limits: spark.readStream.text(topic)
    )
    paths = {name: str(tmp_path / name) for name in ("checkpoint", "report", "output")}
    jobs.score_topic(
        spark,
        ["broker:9092"],
        "flows",
        [str(files / "DT"), str(files / "LR")],
        str(files / "schema.json"),
        ensemble="attack",
        trigger="available-now",
        **paths,
    ).awaitTermination()
    flows = spark.read.parquet(str(files / "flows.parquet"))
    expected = jobs.load_models([str(files / "DT"), str(files / "LR")], "attack").transform(flows)
    columns = ["event_id", "ensemble_prediction"]
    got = spark.read.parquet(paths["output"]).select(columns)
    assert sorted(got.collect()) == sorted(expected.select(columns).collect())
    positives = read_report(spark, paths["report"]).agg(F.sum("positives")).first()[0]
    assert positives == expected.filter("ensemble_prediction = 1").count()


def test_unknown_connector_is_sparks_own_error(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        jobs.read_topic(spark, "broker:9092", "flows")
