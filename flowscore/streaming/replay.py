"""Replaying a labelled dataset as paced batches of messages."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from flowscore.operators.messages import encode_messages
from flowscore.operators.metrics import batch_counts
from flowscore.operators.paging import file_starts, number_by_position, paginate, sorted_table
from flowscore.session import stage_table
from flowscore.sinks import Sink
from flowscore.streaming.batchlog import BatchLog, attempt_number

PAGE_COLUMNS = ("batch_no", "row_no")
# Files that a batch names; one with rows in more of them reads all.
MOST_FILES = 1000

SENT_SCHEMA = StructType(
    [
        StructField("batch_no", IntegerType()),
        StructField("events", LongType()),
        StructField("positives", LongType()),
    ]
)


def replay_batches(
    df: DataFrame,
    rows: int,
    order_by: Sequence[str],
    batches: int | None = None,
    fmt: str = "csv",
    shuffle_seed: int | None = None,
) -> DataFrame:
    """The messages of a replay, ``batch_no row_no value``, as one table."""
    pages = paginate(df, rows, order_by, batches, shuffle_seed)
    return encode_messages(pages, fmt, keep=PAGE_COLUMNS)


def replay_stored_order(df: DataFrame, rows: int, fmt: str = "csv") -> DataFrame:
    """The messages of a replay of stored rows in their own order, as one table."""
    pages = number_by_position(df).selectExpr(f"row_no DIV {int(rows)} AS batch_no", "*")
    return encode_messages(pages, fmt, keep=PAGE_COLUMNS)


def replay_positive_counts(
    df: DataFrame,
    rows: int,
    order_by: Sequence[str],
    label: str = "Label",
    batches: int | None = None,
    shuffle_seed: int | None = None,
) -> DataFrame:
    """Rows and positives of each batch of a replay."""
    pages = paginate(df, rows, order_by, batches, shuffle_seed, carry=[label])
    return batch_counts(pages, label, by=["batch_no"])


def replay(
    df: DataFrame,
    sink: Sink,
    rows: int,
    order_by: Sequence[str] | None = None,
    batches: int = 1,
    delay: float = 1.0,
    label: str = "Label",
    fmt: str = "csv",
    shuffle_seed: int | None = None,
    start_batch: int = 0,
    log: str | None = None,
) -> DataFrame:
    """Send ``batches`` batches of ``rows`` rows, ``delay`` seconds apart; what was sent.

    Without ``order_by`` the rows go as they are stored (parquet files, by path
    and place): nothing is sorted or written. With it they are sorted and written
    to the shared folder once. A batch reads only the files it has rows of. Rows
    go from the executors to the sink; the driver keeps the pace. Rows and
    positives of all batches are counted in one pass over the label beforehand.
    Stops early when the rows run out.

    ``log`` names a folder that gets a row after each batch that was sent. A
    replay that finds rows there goes on after the last one, so a batch is sent
    again only if the failure came between sending and logging. Without a log,
    ``start_batch`` goes on from a given batch: the pages do not depend on the run.
    """
    if rows <= 0:
        raise ValueError(f"rows per page must be positive, not {rows}")
    spark = df.sparkSession
    record = BatchLog(log, SENT_SCHEMA.fields[1:]) if log is not None else None
    sent = _sent_before(spark, record, batches)
    start_batch = max([start_batch, *[row[0] + 1 for row in sent]])
    if start_batch < batches:
        if order_by is None:
            stored = df
        else:
            stored = sorted_table(df, order_by, rows * batches, shuffle_seed)
        low, high = start_batch * rows, batches * rows
        files = stage_table(file_starts(stored), "files")
        numbered = number_by_position(stored, starts=files)
        wanted = numbered.filter((F.col("row_no") >= low) & (F.col("row_no") < high))
        counted = batch_counts(wanted.withColumn("batch_no", F.expr(f"row_no DIV {rows}")), label, ["batch_no"])
        counts = {row.batch_no: (row.events, row.positives) for row in counted.collect()}
        for number in range(start_batch, batches):
            if number not in counts:
                break
            if sent and number > start_batch:
                time.sleep(delay)
            sink(encode_messages(_page(stored, files, number, rows), fmt, keep=PAGE_COLUMNS))
            sent.append((number, *counts[number]))
            if record is not None:
                record.append(spark, number, attempt_number(), *counts[number])
    return spark.createDataFrame(sent, SENT_SCHEMA)


def _sent_before(spark: SparkSession, record: BatchLog | None, batches: int) -> list[tuple]:
    if record is None:
        return []
    logged = record.rows(spark).filter(F.col("batch_id") < batches).orderBy("batch_id").collect()
    return [(row.batch_id, row.events, row.positives) for row in logged]


def _page(stored: DataFrame, files: DataFrame, number: int, rows: int) -> DataFrame:
    """One batch, read from the files that have rows of it."""
    low, high = number * rows, (number + 1) * rows
    mine = files.filter((F.col("__start") < high) & (F.col("__start") + F.col("__rows") > low))
    names = [row[0] for row in mine.select("__file").limit(MOST_FILES + 1).collect()]
    named = names if len(names) <= MOST_FILES else None
    numbered = number_by_position(stored, starts=files, files=named)
    page = numbered.filter((F.col("row_no") >= low) & (F.col("row_no") < high))
    return page.select(F.lit(number).cast("bigint").alias("batch_no"), "*")
