"""Message topics. Needs the Kafka connector on the class path (``session``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def broker_list(brokers: str | Sequence[str]) -> str:
    return brokers if isinstance(brokers, str) else ",".join(brokers)


def kafka_source_options(
    brokers: str | Sequence[str],
    topic: str,
    starting_offsets: str = "latest",
    min_partitions: int | None = None,
    max_records_per_partition: int | None = None,
    max_offsets_per_trigger: int | None = None,
) -> dict[str, str]:
    """Options of the streaming source.

    ``starting_offsets`` counts only for a query without a checkpoint.
    ``min_partitions`` and ``max_records_per_partition`` let several tasks read
    one topic partition, so a hot partition does not become one hot task.
    """
    options = {
        "kafka.bootstrap.servers": broker_list(brokers),
        "subscribe": topic,
        "startingOffsets": starting_offsets,
        "minPartitions": min_partitions,
        "maxRecordsPerPartition": max_records_per_partition,
        "maxOffsetsPerTrigger": max_offsets_per_trigger,
    }
    return {key: str(value) for key, value in options.items() if value is not None}


def read_topic(
    spark: SparkSession, brokers: str | Sequence[str], topic: str, **limits
) -> DataFrame:
    """Stream of messages: ``value`` with ``partition``, ``offset``, ``timestamp``."""
    options = kafka_source_options(brokers, topic, **limits)
    return spark.readStream.format("kafka").options(**options).load()
