"""Where results go. A sink is a function that writes one batch DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from flowscore.sources.kafka import broker_list

Sink = Callable[[DataFrame], None]


def kafka_sink_options(brokers: str | Sequence[str], topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": broker_list(brokers), "topic": topic}


def topic_sink(brokers: str | Sequence[str], topic: str) -> Sink:
    """Send column ``value`` to a topic, straight from the executors."""
    options = kafka_sink_options(brokers, topic)

    def send(messages: DataFrame) -> None:
        messages.select("value").write.format("kafka").options(**options).save()

    return send


def text_sink(path: str) -> Sink:
    """Append column ``value`` as text lines, e.g. to try a replay without a broker."""

    def append(messages: DataFrame) -> None:
        messages.select("value").write.mode("append").text(path)

    return append


def append_csv(df: DataFrame, path: str) -> None:
    """Add rows to a csv folder, each file with a header."""
    df.write.csv(path, mode="append", header=True)


def write_csv(df: DataFrame, path: str) -> None:
    """New csv folder with headers; fails if it exists."""
    df.write.csv(path, mode="errorifexists", header=True)
