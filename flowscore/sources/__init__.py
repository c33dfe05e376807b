"""Where rows come from: schema files, datasets, file streams, topics."""

from flowscore.sources.datasets import read_dataset, stream_dataset
from flowscore.sources.kafka import kafka_source_options, read_topic
from flowscore.sources.schemas import as_schema, load_schema, required_fields

__all__ = [
    "as_schema",
    "kafka_source_options",
    "load_schema",
    "read_dataset",
    "read_topic",
    "required_fields",
    "stream_dataset",
]
