import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import workload as w
from conftest import plan_of
from flowscore.operators.messages import encode_messages
from flowscore.sources import read_dataset, stream_dataset
from flowscore.streaming import scoring as S

SCHEMA = w.MESSAGE_SCHEMA


@pytest.fixture(scope="module")
def records(spark, data):
    # A session of its own, as a streaming query has: see ``report_batches``.
    return w.event_flows(spark.newSession(), data).drop(w.LABEL)


def message_stream(spark, folder, **limits):
    """Messages kept as parquet files, standing in for a topic."""
    schema = "value STRING, partition INT, offset BIGINT, timestamp TIMESTAMP"
    return stream_dataset(spark, folder, spark.createDataFrame([], schema).schema, **limits)


def put(records, folder, files=1):
    encode_messages(records, "csv").select(
        "value",
        F.lit(0).alias("partition"),
        F.lit(1).cast("long").alias("offset"),
        F.lit(None).cast("timestamp").alias("timestamp"),
    ).repartition(files).write.mode("append").parquet(folder)


def start(spark, tmp_path, folder, output=True, **options):
    limits = options.pop("limits", {})
    scored = S.score_messages(
        message_stream(spark, folder, **limits), SCHEMA, w.event_models()["value_rule"]
    )
    return S.start_scoring(
        scored,
        checkpoint=str(tmp_path / "checkpoint"),
        report=str(tmp_path / "report"),
        output=str(tmp_path / "rows") if output else None,
        prediction="prediction",
        **options,
    )


def test_stream_scores_like_batch_and_resumes_from_the_checkpoint(spark, records, tmp_path):
    folder = str(tmp_path / "topic.parquet")
    put(records.filter("event_id < 400"), folder, files=3)
    one_file = {"max_files_per_trigger": 1}
    start(spark, tmp_path, folder, trigger="available-now", limits=one_file).awaitTermination()
    first = S.read_report(spark, str(tmp_path / "report"))
    assert first.count() == 3
    assert first.agg(F.sum("events")).first()[0] == 400

    put(records.filter("event_id >= 400"), folder)
    start(spark, tmp_path, folder, trigger="available-now").awaitTermination()
    scored = S.read_batches(spark, str(tmp_path / "rows"), str(tmp_path / "report"))
    expected = w.event_models()["value_rule"].transform(records)
    columns = ["event_id", "value", "k", "prediction"]
    order = lambda rows: sorted(tuple(r) for r in rows)
    assert order(scored.select(columns).collect()) == order(expected.select(columns).collect())
    totals = S.read_report(spark, str(tmp_path / "report")).agg(
        F.sum("events"), F.sum("positives"), F.max("batch_id")
    )
    assert tuple(totals.first()) == (
        records.count(), expected.filter("prediction = 1").count(), 3,
    )


@pytest.mark.parametrize("output", [True, False])
@pytest.mark.parametrize("trigger", ["micro-batch", "interval", "once"])
def test_triggers(spark, records, tmp_path, trigger, output):
    folder = str(tmp_path / "topic.parquet")
    put(records, folder)
    query = start(spark, tmp_path, folder, output, trigger=trigger, interval="200 milliseconds")
    if trigger == "once":
        query.awaitTermination()
    else:
        query.processAllAvailable()
        query.stop()
    report = S.read_report(spark, str(tmp_path / "report")).collect()
    assert sum(r.events for r in report) == records.count()
    assert all(r.seconds > 0 and r.events_per_second > 0 for r in report)


def test_a_batch_run_again_replaces_its_report_and_rows(spark, records, tmp_path):
    scored = w.event_models()["value_rule"].transform(records)
    report, rows = str(tmp_path / "report"), str(tmp_path / "rows")
    handle = S.report_batches("prediction", report, rows)
    handle(scored.limit(10), 0)
    handle(scored, 0)
    handle(scored.filter("value > 100"), 1)
    got = {r.batch_id: (r.events, r.positives) for r in S.read_report(spark, report).collect()}
    positives = scored.filter("prediction = 1").count()
    assert got == {0: (records.count(), positives), 1: (positives, positives)}
    visible = S.read_batches(spark, rows, report)
    assert visible.count() == records.count() + positives
    assert spark.read.parquet(rows).count() == visible.count() + 10


def test_a_batch_is_computed_once(spark, records, tmp_path):
    for output in (None, str(tmp_path / "rows")):
        seen = spark.sparkContext.accumulator(0)

        def count(rows):
            for row in rows:
                seen.add(1)
                yield row

        counted = records.sparkSession.createDataFrame(records.rdd.mapPartitions(count), records.schema)
        scored = w.event_models()["value_rule"].transform(counted)
        S.report_batches("prediction", str(tmp_path / "report"), output)(scored, 0)
        assert seen.value == records.count()


def test_empty_batch_is_reported(spark, records, tmp_path):
    scored = w.event_models()["value_rule"].transform(records.limit(0))
    for number, output in enumerate([None, str(tmp_path / "rows")]):
        report = str(tmp_path / f"report{number}")
        S.report_batches("prediction", report, output)(scored, 0)
        row = S.read_report(spark, report).first()
        assert (row.events, row.positives) == (0, 0)


def test_untimed_batch_has_no_rate(spark, records, tmp_path, monkeypatch):
    monkeypatch.setattr(S.time, "perf_counter", lambda: 1.0)
    scored = w.event_models()["value_rule"].transform(records)
    S.report_batches("prediction", str(tmp_path / "report"))(scored, 0)
    row = S.read_report(spark, str(tmp_path / "report")).first()
    assert row.seconds == 0 and row.events_per_second is None


def test_unknown_trigger(spark, records):
    with pytest.raises(ValueError, match="hourly"):
        S.apply_trigger(None, "hourly")


def test_incomplete_messages_do_not_reach_the_model(spark):
    rows = [("1,2,error,150.0,3",), ("bad,2,error,150.0,3",), ("",), ("5,,,99.0,",)]
    scored = S.score_messages(
        spark.createDataFrame(rows, "value STRING"), SCHEMA, w.event_models()["value_rule"]
    )
    assert sorted((r.event_id, r.prediction) for r in scored.collect()) == [(1, 1.0), (5, 0.0)]


def test_scoring_is_narrow(spark, data):
    path = f"{data}/events.parquet"
    messages = entry.messages_of(w.with_event_features(read_dataset(spark, path)), "csv")
    scored = S.score_messages(messages, SCHEMA, w.event_ensemble())
    plan = plan_of(scored)
    assert "Exchange" not in plan and "Python" not in plan


def test_fitted_model_on_a_stream(spark, data, tmp_path):
    flows = w.event_flows(spark, data)
    from flowscore.plans.setups import build_setup

    model = build_setup("LR", ["value", "k"], w.LABEL, maxIter=2).fit(flows)
    folder = str(tmp_path / "topic.parquet")
    put(flows.drop(w.LABEL), folder)
    scored = S.score_messages(message_stream(spark, folder), SCHEMA, model)
    S.start_table(
        scored, str(tmp_path / "rows"), str(tmp_path / "cp"), "available-now"
    ).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "rows"))
    assert {"prediction", "rawPrediction", "probability", "_meta"} <= set(out.columns)
    assert out.count() == flows.count()
