"""Scoring a stream of messages.

Decode, check, score is a stateless chain of projections and one filter: no
shuffle and no state store, so a micro-batch costs what its rows cost.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.ml import Transformer
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from flowscore.functions.names import column
from flowscore.operators.messages import check_messages, decode_messages, keep_complete
from flowscore.operators.scoring import model_columns, score
from flowscore.streaming.batchlog import BatchLog, append_rows, attempt_number, visible_rows

# Names of the triggers.
TRIGGERS = ("micro-batch", "interval", "available-now", "once")

# What the log says of a batch, besides its number and the attempt that counts.
REPORT_FIELDS = (
    StructField("events", LongType()),
    StructField("positives", LongType()),
    StructField("rejected", LongType()),
    StructField("seconds", DoubleType()),
    StructField("events_per_second", DoubleType()),
)

def score_messages(
    messages: DataFrame, schema: StructType, model: Transformer, fmt: str = "csv"
) -> DataFrame:
    """Messages (batch or stream) to scored records; incomplete records are dropped."""
    records = keep_complete(decode_messages(messages, schema, fmt), schema)
    return score(records, model)


def apply_trigger(
    writer: DataStreamWriter, trigger: str = "micro-batch", interval: str = "1 second"
) -> DataStreamWriter:
    """``micro-batch`` starts the next batch at once, ``interval`` at fixed times,
    ``available-now`` and ``once`` stop after what is there, the latter in one batch."""
    if trigger not in TRIGGERS:
        raise ValueError(f"trigger {trigger!r} is not one of {TRIGGERS}")
    if trigger == "interval":
        return writer.trigger(processingTime=interval)
    if trigger == "available-now":
        return writer.trigger(availableNow=True)
    if trigger == "once":
        return writer.trigger(once=True)
    return writer


def _written(df: DataFrame, path: str | None, batch_id: int, attempt: int, **counts: Column) -> dict:
    """Run ``df`` once, into the table at ``path`` or nowhere; what that pass counted."""
    seen = Observation()
    observed = df.observe(seen, *[value.alias(name) for name, value in counts.items()])
    if path is None:
        observed.write.format("noop").mode("overwrite").save()
    else:
        append_rows(observed, path, batch_id, attempt)
    # A pass that Spark found to be empty before it ran counts nothing.
    return {name: (seen.get or {}).get(name) or 0 for name in counts}


def _log_batch(
    log: BatchLog, spark: SparkSession, batch_id: int, attempt: int, counts: dict, seconds: float
) -> None:
    events, positives = counts["events"], counts["positives"]
    rate = events / seconds if seconds > 0 else None
    rejected = counts.get("rejected")
    log.append(spark, batch_id, attempt, events, positives, rejected, seconds, rate)


def _scored_counts(prediction: str) -> dict[str, Column]:
    positive = F.count_if(column(prediction) == 1)
    return {"events": F.count(F.lit(1)), "positives": positive}


def report_batches(
    prediction: str, report: str, output: str | None = None
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler of scored rows: the rows to ``output``, a log row to ``report``.

    A batch is computed once, by the pass that writes it; the counts are taken
    on the way. ``seconds`` is the time of that pass. A batch that is run again
    after a failure replaces its first attempt, see ``batchlog``.

    For use in a query, which has a session of its own: in a session that has
    counted so, Spark cannot send out a model whose training summary names it.
    """
    log = BatchLog(report, REPORT_FIELDS)

    def handle(batch: DataFrame, batch_id: int) -> None:
        attempt, start = attempt_number(), time.perf_counter()
        counts = _written(batch, output, batch_id, attempt, **_scored_counts(prediction))
        _log_batch(log, batch.sparkSession, batch_id, attempt, counts, time.perf_counter() - start)

    return handle


def split_batches(
    schema: StructType,
    model: Transformer,
    report: str,
    output: str | None = None,
    rejected: str | None = None,
    fmt: str = "csv",
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler of messages: scored rows and rejected messages, each to its table.

    A payload is parsed once: the checked batch is kept, in memory or on disk,
    until both tables are written. Every message is either in ``output`` or, with
    the reason, in ``rejected``; both tables count from the same log row on.
    """
    log = BatchLog(report, REPORT_FIELDS)
    prediction = model_columns(model).prediction

    def handle(batch: DataFrame, batch_id: int) -> None:
        attempt, start = attempt_number(), time.perf_counter()
        checked = check_messages(batch, schema, fmt).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good = checked.filter("_reason IS NULL").drop("_reason", "_payload")
            counts = _written(
                score(good, model), output, batch_id, attempt, **_scored_counts(prediction)
            )
            counts |= _written(
                _rejected_table(checked), rejected, batch_id, attempt, rejected=F.count(F.lit(1))
            )
        finally:
            checked.unpersist()
        _log_batch(log, batch.sparkSession, batch_id, attempt, counts, time.perf_counter() - start)

    return handle


def _rejected_table(checked: DataFrame) -> DataFrame:
    """Rejected messages with reason and payload; what their source says of them, else null."""
    kinds = {"partition": "int", "offset": "long", "timestamp": "timestamp"}
    known = checked.schema["_meta"].dataType.fieldNames() if "_meta" in checked.columns else []
    return checked.filter("_reason IS NOT NULL").select(
        F.col("_reason").alias("reason"),
        F.col("_payload").alias("payload"),
        *[
            (F.col(f"_meta.{name}") if name in known else F.lit(None)).cast(kind).alias(name)
            for name, kind in kinds.items()
        ],
    )


def read_report(spark: SparkSession, report: str) -> DataFrame:
    """A row per batch; a null rate marks a batch too short to time, a null
    ``rejected`` a query that drops incomplete messages without counting them."""
    return BatchLog(report, REPORT_FIELDS).read(spark).drop("attempt")


def read_batches(spark: SparkSession, path: str, report: str) -> DataFrame:
    """The rows of a table that the batches of ``report`` wrote, with their ``batch_id``."""
    log = BatchLog(report, REPORT_FIELDS).read(spark)
    return visible_rows(spark.read.parquet(path), log)


def start_scoring(
    scored: DataFrame,
    checkpoint: str,
    report: str,
    output: str | None = None,
    prediction: str | None = None,
    model: Transformer | None = None,
    trigger: str = "micro-batch",
    interval: str = "1 second",
) -> StreamingQuery:
    """Start the query over a scored stream; the caller awaits or stops it.

    ``checkpoint`` is required: with it a restarted query goes on where it
    stopped instead of at the newest message. The prediction column is named
    directly or by ``model``.
    """
    if prediction is None and model is None:
        raise ValueError("name the prediction column, or give the model")
    prediction = prediction or model_columns(model).prediction
    handler = report_batches(prediction, report, output)
    return start_batches(scored, handler, checkpoint, trigger, interval)


def start_batches(
    stream: DataFrame,
    handler: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: str = "micro-batch",
    interval: str = "1 second",
) -> StreamingQuery:
    """Start a query that hands each micro-batch to ``handler``; the caller awaits or stops it."""
    writer = (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(handler)
    )
    return apply_trigger(writer, trigger, interval).start()


def start_table(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    trigger: str = "micro-batch",
    interval: str = "1 second",
) -> StreamingQuery:
    """Append a stream to a parquet folder, exactly once."""
    writer = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )
    return apply_trigger(writer, trigger, interval).start()
