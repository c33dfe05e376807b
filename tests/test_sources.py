import json

import pytest
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from conftest import plan_of
from flowscore.session import kafka_package, run_path, shared_dir
from flowscore.sinks import append_csv, kafka_sink_options, write_csv
from flowscore.sources import (
    kafka_source_options,
    load_schema,
    read_dataset,
    required_fields,
    stream_dataset,
)

SCHEMA = StructType(
    [
        StructField("a", LongType(), False),
        StructField("b", StringType()),
        StructField("c", DoubleType(), False),
    ]
)


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("only_fields", [True, False])
def test_schema_file_variants(spark, tmp_path, indent, only_fields):
    content = SCHEMA.jsonValue()
    if only_fields:
        content = {"fields": content["fields"]}
    path = tmp_path / "schema.json"
    path.write_text(json.dumps(content, indent=indent))
    assert load_schema(spark, str(path)) == SCHEMA


def test_required_fields_are_the_non_nullable_ones():
    assert required_fields(SCHEMA) == ["a", "c"]
    assert required_fields(StructType([StructField("x", LongType())])) == []


def test_given_schema_prunes_and_fills(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(3).selectExpr("id AS a", "'x' AS dropped").write.parquet(path)
    rows = read_dataset(spark, path, SCHEMA).collect()
    assert sorted(row.a for row in rows) == [0, 1, 2]
    assert all(row.b is None and row.c is None for row in rows)


def test_csv_needs_a_schema_and_suffix_decides(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    spark.createDataFrame([(1, "x", 2.5)], SCHEMA).write.csv(path)
    assert [tuple(r) for r in read_dataset(spark, path, SCHEMA).collect()] == [(1, "x", 2.5)]
    with pytest.raises(ValueError, match="schema"):
        read_dataset(spark, path)
    for wrong in (
        lambda p: read_dataset(spark, p, fmt="orc"),
        lambda p: stream_dataset(spark, p, SCHEMA),
    ):
        with pytest.raises(ValueError, match="suffix"):
            wrong(str(tmp_path / "t.orc"))


def test_batch_path_without_suffix_is_parquet(spark, tmp_path):
    path = str(tmp_path / "flows")
    spark.range(3).write.parquet(path)
    assert read_dataset(spark, path).count() == 3


def test_stream_of_partitioned_folder(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    df = spark.createDataFrame([(1, "x", 2.5), (2, "y", 3.5)], SCHEMA)
    df.write.partitionBy(df.columns[1]).parquet(path)
    stream = stream_dataset(spark, path, SCHEMA)
    query = stream.writeStream.format("memory").queryName("parted").trigger(availableNow=True).start()
    query.awaitTermination()
    names = df.columns
    assert {tuple(r) for r in spark.table("parted").select(names).collect()} == {
        tuple(r) for r in df.collect()
    }


def test_stream_of_folder_and_of_file_see_the_same_rows(spark, data, tmp_path):
    batch = read_dataset(spark, f"{data}/events.parquet")
    folder = str(tmp_path / "events.parquet")
    batch.repartition(4).write.parquet(folder)
    for number, path in enumerate([f"{data}/events.parquet", folder]):
        out = str(tmp_path / f"out{number}")
        stream = stream_dataset(spark, path, batch.schema, max_files_per_trigger=2)
        stream.select("event_id").writeStream.format("parquet").option(
            "checkpointLocation", f"{out}-checkpoint"
        ).trigger(availableNow=True).start(out).awaitTermination()
        assert spark.read.parquet(out).distinct().count() == batch.count()


def test_kafka_options():
    assert kafka_source_options(["a:1", "b:2"], "flows") == {
        "kafka.bootstrap.servers": "a:1,b:2",
        "subscribe": "flows",
        "startingOffsets": "latest",
    }
    tuned = kafka_source_options("a:1", "t", "earliest", 64, 1_000_000, 5_000_000)
    assert tuned["startingOffsets"] == "earliest"
    assert tuned["minPartitions"] == "64"
    assert tuned["maxRecordsPerPartition"] == "1000000"
    assert tuned["maxOffsetsPerTrigger"] == "5000000"
    assert kafka_sink_options(["a:1"], "t") == {"kafka.bootstrap.servers": "a:1", "topic": "t"}
    assert "spark-sql-kafka-0-10_2.13:4." in kafka_package()


def test_csv_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5)], "a INT, b DOUBLE").coalesce(1)
    log = str(tmp_path / "log")
    append_csv(df, log)
    append_csv(df, log)
    assert spark.read.csv(log, header=True, schema=df.schema).count() == 2
    once = str(tmp_path / "once")
    write_csv(df, once)
    with pytest.raises(Exception, match="(?i)exists"):
        write_csv(df, once)


def test_shared_dir_is_the_sessions_own(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    assert run_path(spark, "x").startswith(shared_dir(spark))
    assert run_path(spark, "x") != run_path(spark, "x")


def test_filter_and_columns_reach_the_scan(spark, data):
    df = read_dataset(spark, f"{data}/events.parquet").filter("value > 100").select("event_id")
    plan = plan_of(df)
    assert "GreaterThan(value,100.0)" in plan
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan
