"""A log with one row for each micro-batch, and tables whose rows it makes visible.

The log is cut into segments of a fixed number of batches. A batch writes its
segment anew, its own row and those before, to one of two sides in turn: while
one side is replaced the other still holds every batch before. So there are two
files a segment, whatever the number of batches. A batch may be run again after
a failure: the row that was written last wins.

Rows of a batch are appended to plain tables with the batch's number and the
attempt that wrote them. Only the attempt that the log names counts, so an
attempt that failed half-way leaves nothing to be seen.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from flowscore.functions.names import quote_all

# Columns of every log and of the tables it governs; an attempt is named by its
# start in microseconds, so a later one has the larger number.
KEY = ("batch_id", "attempt")
SEGMENT_BATCHES = 64
# Spark's name for a folder that is not there.
NOT_THERE = "PATH_NOT_FOUND"
SIDES = 2


def attempt_number() -> int:
    return time.time_ns() // 1000


class BatchLog:
    """Appends rows of ``fields`` to the log at ``path`` and reads them."""

    def __init__(self, path: str, fields: Sequence[StructField], segment: int = SEGMENT_BATCHES):
        if segment < 1:
            raise ValueError(f"a segment has 1 batch or more, not {segment}")
        self.path, self.segment = path.rstrip("/"), segment
        keys = [StructField(name, LongType()) for name in KEY]
        self.schema = StructType([*keys, *fields])
        self._number: int | None = None
        self._rows: dict[int, tuple] = {}

    def _segment_path(self, number: int) -> str:
        return f"{self.path}/segment={number}"

    def _load(self, spark: SparkSession, number: int) -> None:
        """The rows of a segment so far: needed once after a start, then kept here."""
        self._number, self._rows = number, {}
        sides = [f"{self._segment_path(number)}/side={side}" for side in range(SIDES)]
        rows: list[tuple] = []
        for side in sides:
            try:
                found = spark.read.schema(self.schema).parquet(side).collect()
            except AnalysisException as error:
                if error.getCondition() != NOT_THERE:
                    raise
                found = []
            rows += map(tuple, found)
        for row in sorted(rows, key=lambda r: r[1]):
            self._rows[row[0]] = row

    def append(self, spark: SparkSession, batch_id: int, attempt: int, *values) -> None:
        """Make this attempt the one that counts for its batch."""
        number = batch_id // self.segment
        if number != self._number:
            self._load(spark, number)
        self._rows[batch_id] = (batch_id, attempt, *values)
        rows = spark.createDataFrame(list(self._rows.values()), self.schema).coalesce(1)
        side = f"{self._segment_path(number)}/side={batch_id % SIDES}"
        rows.write.mode("overwrite").parquet(side)

    def rows(self, spark: SparkSession) -> DataFrame:
        """``read``, and no rows where nothing was logged yet."""
        try:
            return self.read(spark)
        except AnalysisException as error:
            if error.getCondition() != NOT_THERE:
                raise
            return spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession) -> DataFrame:
        """One row per batch: the one written last."""
        every = spark.read.schema(self.schema).parquet(f"{self.path}/segment=*/side=*")
        row = F.struct(*quote_all(self.schema.fieldNames()))
        last = every.groupBy("batch_id").agg(F.max_by(row, F.col("attempt")).alias("row"))
        return last.select("row.*")


def append_rows(df: DataFrame, path: str, batch_id: int, attempt: int) -> None:
    """Add a batch's rows to a table: they count once the log names the attempt."""
    keys = {"batch_id": F.lit(batch_id).cast("long"), "attempt": F.lit(attempt).cast("long")}
    clash = sorted(set(keys).intersection(df.columns))
    if clash:
        raise ValueError(f"columns {clash} are also those of the log")
    df.withColumns(keys).write.mode("append").parquet(path)


def visible_rows(rows: DataFrame, log: DataFrame) -> DataFrame:
    """The rows of attempts that count, without the attempt's number."""
    return rows.join(log.select(*KEY), list(KEY), "left_semi").drop("attempt")
