"""Micro-batches split into scored and rejected rows, their log, and restarts."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

import workload as w
from conftest import plan_of
from flowscore.operators.messages import check_messages
from flowscore.streaming import scoring as S
from flowscore.streaming.batchlog import BatchLog, append_rows, visible_rows
from flowscore.streaming.faults import InjectedFault, fail_once, run_with_restarts

MESSAGES = [
    "1,2,error,150.0,3",
    "bad,2,error,150.0,3",
    "",
    "5,,,99.0,",
    "7,1,view,,4",
    "bad,1,view,,4",
    "8,1,click,500.0,1,more",
]


def split(**paths):
    return S.split_batches(w.MESSAGE_SCHEMA, w.event_models()["value_rule"], **paths)


def messages(spark, rows=MESSAGES):
    # A session of its own, as a streaming query has: see ``report_batches``.
    df = spark.newSession().createDataFrame([(r,) for r in rows], "value STRING")
    return df.withColumns({"partition": F.lit(3), "offset": F.monotonically_increasing_id()})


@pytest.fixture
def paths(tmp_path):
    return {name: str(tmp_path / name) for name in ("report", "output", "rejected")}


def test_every_message_is_scored_or_rejected_with_a_reason(spark, paths):
    split(**paths)(messages(spark), 0)
    rows = S.read_batches(spark, paths["output"], paths["report"]).collect()
    assert sorted((r.event_id, r.prediction) for r in rows) == [(1, 1.0), (5, 0.0), (8, 1.0)]
    gone = S.read_batches(spark, paths["rejected"], paths["report"])
    assert sorted((r.payload, r.reason, r.partition) for r in gone.collect()) == [
        ("", "no field could be read", 3),
        ("7,1,view,,4", "missing: value", 3),
        ("bad,1,view,,4", "missing: event_id, value", 3),
        ("bad,2,error,150.0,3", "missing: event_id", 3),
    ]
    (row,) = S.read_report(spark, paths["report"]).collect()
    assert (row.events, row.positives, row.rejected) == (3, 2, 4)


@pytest.mark.parametrize("rows", [[], [""], ["1,2,error,150.0,3"]])
def test_batches_without_rows_of_one_kind(spark, paths, rows):
    split(**paths)(messages(spark, rows or [""]).limit(len(rows)), 0)
    (row,) = S.read_report(spark, paths["report"]).collect()
    assert (row.events, row.rejected) == (rows.count(MESSAGES[0]), rows.count(""))


def test_a_payload_is_parsed_once(spark, paths, monkeypatch):
    plans = []
    written = S._written
    monkeypatch.setattr(S, "_written", lambda df, *a, **b: (plans.append(plan_of(df)), written(df, *a, **b))[1])
    split(**paths)(messages(spark), 0)
    assert len(plans) == 2
    for plan in plans:
        own, kept = plan.split("InMemoryRelation")
        assert "from_csv" not in own and kept.count("from_csv") == 1


def test_json_reasons_and_a_schema_without_required_fields(spark):
    rows = messages(spark, ['{"event_id":1,"value":2.5}', '{"value":2.5}', "nope"])
    found = check_messages(rows, w.MESSAGE_SCHEMA, "json").collect()
    assert [r._reason for r in found] == [None, "missing: event_id", "no field could be read"]
    assert [r._payload for r in found] == [None, '{"value":2.5}', "nope"]
    loose = type(w.MESSAGE_SCHEMA).fromDDL("event_id BIGINT, value DOUBLE")
    assert all(r._reason is None for r in check_messages(rows, loose, "json").collect())
    with pytest.raises(ValueError, match="_reason"):
        check_messages(rows, type(loose).fromDDL("_reason STRING"))


def test_the_log_keeps_the_last_attempt_in_few_files(spark, tmp_path):
    path, fields = str(tmp_path / "log"), [StructField("events", LongType())]
    log = BatchLog(path, fields, segment=8)
    for batch in range(20):
        log.append(spark, batch, 100 + batch, batch)
        if batch == 11:  # another driver goes on, and runs the last batch again
            log = BatchLog(path, fields, segment=8)
            log.append(spark, batch, 500, -1)
    got = {r.batch_id: (r.attempt, r.events) for r in log.read(spark).collect()}
    assert got == {b: (100 + b, b) for b in range(20)} | {11: (500, -1)}
    assert len(list(Path(path).rglob("*.parquet"))) <= 6


def test_a_side_lost_while_it_is_written_costs_no_earlier_batch(spark, tmp_path):
    path, fields = str(tmp_path / "log"), [StructField("events", LongType())]
    log = BatchLog(path, fields)
    for batch in range(5):
        log.append(spark, batch, batch, batch)
    for file in Path(path).rglob("side=0/*.parquet"):  # batch 4's side
        file.unlink()
    log = BatchLog(path, fields)
    assert sorted(r.batch_id for r in log.read(spark).collect()) == [0, 1, 2, 3]
    log.append(spark, 4, 9, 4)
    assert sorted(r.batch_id for r in log.read(spark).collect()) == [0, 1, 2, 3, 4]


def test_rows_of_an_attempt_that_is_not_logged_are_not_seen(spark, tmp_path):
    rows, log = str(tmp_path / "rows"), BatchLog(str(tmp_path / "log"), [])
    append_rows(spark.range(3), rows, 0, 1)
    append_rows(spark.range(10, 12), rows, 0, 2)
    append_rows(spark.range(20, 21), rows, 1, 3)
    log.append(spark, 0, 2)
    seen = visible_rows(spark.read.parquet(rows), log.read(spark))
    assert sorted(r.id for r in seen.collect()) == [10, 11]
    with pytest.raises(ValueError, match="attempt"):
        append_rows(spark.range(1).withColumn("attempt", F.lit(1)), rows, 2, 1)


def test_restarts_after_faults_between_output_and_commit(spark, tmp_path, paths):
    folder = str(tmp_path / "topic.parquet")
    for part in range(3):
        rows = [f"{part * 10 + i},1,error,{i * 40}.5,2" for i in range(10)] + ["bad"]
        spark.createDataFrame([(r,) for r in rows], "value STRING").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("value STRING").option("maxFilesPerTrigger", 1).parquet(folder)
    handler = fail_once(split(**paths), [0, 2])
    start = lambda: S.start_batches(stream, handler, str(tmp_path / "checkpoint"), "available-now")
    assert run_with_restarts(start) == 2
    rows = S.read_batches(spark, paths["output"], paths["report"])
    assert sorted(r.event_id for r in rows.collect()) == list(range(30))
    assert spark.read.parquet(paths["output"]).count() == 50
    assert S.read_batches(spark, paths["rejected"], paths["report"]).count() == 3
    assert {r.batch_id: r.rejected for r in S.read_report(spark, paths["report"]).collect()} == {0: 1, 1: 1, 2: 1}


def test_other_failures_and_too_many_faults_are_raised(spark, tmp_path):
    stream = spark.readStream.format("rate").load()

    def broken(batch, batch_id):
        raise KeyError("broken")

    def always(batch, batch_id):
        raise InjectedFault("always")

    for number, (handler, match) in enumerate([(broken, "broken"), (always, "always")]):
        start = lambda: S.start_batches(stream, handler, str(tmp_path / str(number)), "once")  # noqa: B023
        with pytest.raises(Exception, match=match):
            run_with_restarts(start, most=1)
