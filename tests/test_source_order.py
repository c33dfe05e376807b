"""Replay of stored rows in their own order, with a log that a restart goes on from."""

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from flowscore.operators import paging
from flowscore.sinks import text_sink
from flowscore.streaming import replay as R


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("flows") / "flows.parquet")
    ids = spark.range(0, 2500, 1, 4).selectExpr("id * 7919 % 2500 AS id", "IF(id % 4 = 0, 1D, 0D) AS Label")
    ids.write.option("maxRecordsPerFile", 300).parquet(path)
    return spark.read.parquet(path)


def expected(stored):
    rows = stored.select("id", "_metadata.file_path", "_metadata.row_index").collect()
    return [r.id for r in sorted(rows, key=lambda r: (r.file_path, r.row_index))]


def test_numbers_follow_files_and_places_however_they_are_read(spark, stored):
    want = expected(stored)
    for size in ("2k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            numbered = paging.number_by_position(stored)
            assert [r.id for r in numbered.orderBy("row_no").collect()] == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.row_no for r in numbered.orderBy("row_no").collect()] == list(range(2500))


def test_rows_are_not_shuffled(spark, stored, monkeypatch):
    def exchanged(df):
        return [x for x in plan_of(df).split("\n") if "Exchange" in x and "id#" in x]

    assert not exchanged(paging.number_by_position(stored))
    monkeypatch.setattr(paging, "BROADCAST_FILES", 2)
    assert paging.number_by_position(stored).count() == 2500


def test_sorted_table_has_the_order_of_number_rows(spark, stored):
    want = paging.number_rows(stored, ["Label"]).orderBy("row_no").collect()
    table = paging.sorted_table(stored, ["Label"])
    assert [tuple(r) for r in paging.number_by_position(table).orderBy("row_no").collect()] == [tuple(r) for r in want]


def test_replay_in_stored_order_goes_on_after_a_failure(spark, stored, tmp_path, monkeypatch):
    written = []
    stage = R.stage_table
    monkeypatch.setattr(R, "stage_table", lambda df, label: (written.append((label, df.columns)), stage(df, label))[1])
    monkeypatch.setattr(R, "sorted_table", None)
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    send, calls = text_sink(out), []

    def sink(messages):
        calls.append(plan_of(messages))
        if len(calls) == 3:
            raise OSError("broker is gone")
        send(messages)

    options = {"batches": 9, "delay": 0, "log": log}
    with pytest.raises(OSError, match="gone"):
        R.replay(stored, sink, 400, **options)
    sent = R.replay(stored, sink, 400, **options)
    rows = sorted(tuple(r) for r in sent.collect())
    assert [r[:2] for r in rows] == [(i, 400) for i in range(6)] + [(6, 100)]
    assert sum(r[2] for r in rows) == 625
    lines = spark.read.text(out)
    assert sorted(int(r.value.split(",")[0]) for r in lines.collect()) == list(range(2500))
    # Nothing but the starts of the files is written, and nothing is sorted.
    assert {tuple(columns) for _, columns in written} == {("__file", "__start", "__rows")}
    assert not any("rangepartitioning" in plan for plan in calls)
    again = R.replay(stored, sink, 400, **options)
    assert sorted(map(tuple, again.collect())) == rows
    assert len(calls) == 8


def test_a_batch_reads_its_files_only(spark, stored, monkeypatch):
    named = []
    number = R.number_by_position
    monkeypatch.setattr(R, "number_by_position", lambda df, **k: (named.append(k["files"]), number(df, **k))[1])
    page = R._page(stored, paging.file_starts(stored), 1, 400)
    assert [r.row_no for r in page.orderBy("row_no").collect()] == list(range(400, 800))
    assert 2 <= len(named[0]) <= 3
    monkeypatch.setattr(R, "MOST_FILES", 1)
    assert R._page(stored, paging.file_starts(stored), 1, 400).count() == 400
    assert named[1] is None


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "none.parquet")
    spark.createDataFrame([], "id BIGINT, Label DOUBLE").write.parquet(path)
    empty = spark.read.parquet(path)
    assert paging.number_by_position(empty).count() == 0
    assert R.replay(empty, text_sink(str(tmp_path / "out")), 10, batches=2, delay=0).count() == 0
    with pytest.raises(ValueError, match="positive"):
        R.replay(empty, print, 0)


@pytest.mark.parametrize("first", [40, 48, 97, 100])
def test_first_rows_of_far_times_are_exact(spark, first):
    base = 253_400_000_000_000_000
    df = spark.range(100).select("id", F.timestamp_micros(F.lit(base) + F.col("id")).alias("until"))
    numbered = paging.number_rows(df, ["until"], first=first)
    assert sorted(r.id for r in numbered.select("id").collect()) == list(range(first))
