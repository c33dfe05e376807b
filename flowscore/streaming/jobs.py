"""The two topic jobs from end to end: score what arrives, replay a dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from flowscore.operators.ensemble import VotingEnsemble
from flowscore.sinks import topic_sink
from flowscore.sources import as_schema, read_dataset, read_topic
from flowscore.streaming.replay import replay
from flowscore.streaming.scoring import (
    score_messages,
    split_batches,
    start_batches,
    start_scoring,
)


def load_models(paths: Sequence[str], ensemble: str | None = None) -> Transformer:
    """One saved model, or an ensemble of several (``majority`` unless named)."""
    models = [PipelineModel.load(path) for path in paths]
    if ensemble is None and len(models) == 1:
        return models[0]
    return VotingEnsemble(models, mode=ensemble)


def score_topic(
    spark: SparkSession,
    brokers: str | Sequence[str],
    topic: str,
    models: Sequence[str],
    schema: str | StructType,
    checkpoint: str,
    report: str,
    fmt: str = "csv",
    ensemble: str | None = None,
    output: str | None = None,
    rejected: str | None = None,
    trigger: str = "micro-batch",
    interval: str = "1 second",
    **limits,
) -> StreamingQuery:
    """Start scoring a topic with saved models; ``schema`` is a struct or a schema file.

    ``limits`` are those of ``kafka_source_options``. The report gets a row per
    batch, ``output`` the scored records and ``rejected`` the messages that lack a
    required field, with the reason; see ``read_report`` and ``read_batches``. The
    caller awaits the query.
    """
    model = load_models(models, ensemble)
    messages = read_topic(spark, brokers, topic, **limits)
    schema = as_schema(spark, schema)
    if rejected is None:
        scored = score_messages(messages, schema, model, fmt)
        return start_scoring(
            scored, checkpoint, report, output, model=model, trigger=trigger, interval=interval
        )
    handler = split_batches(schema, model, report, output, rejected, fmt)
    return start_batches(messages, handler, checkpoint, trigger, interval)


def replay_to_topic(
    spark: SparkSession,
    dataset: str,
    schema: str | StructType,
    brokers: str | Sequence[str],
    topic: str,
    rows: int,
    order_by: Sequence[str] | None = None,
    **options,
) -> DataFrame:
    """Send a dataset to a topic in paced batches, in its own order if no other is
    given; ``options`` are those of ``replay``."""
    flows = read_dataset(spark, dataset, as_schema(spark, schema))
    return replay(flows, topic_sink(brokers, topic), rows, order_by, **options)
