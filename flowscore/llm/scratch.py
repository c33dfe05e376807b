"""Stored intermediate tables that are deleted once what follows them is stored."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from flowscore.session import run_path

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
# Bytes after which an Arrow batch of texts is sent to a Python worker.
BATCH_BYTES = 4 << 20
# Bytes of batches after which a Python worker gives back the memory that it holds free.
RETURN_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches end after BATCH_BYTES, unless they end sooner already.

    Batches of 10,000 rows hold as much as the texts are long, once in the
    executor and again in each Python worker of a task. A row is never split.
    """
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(BATCH_SETTING).lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def give_back() -> None:
    """Return to the system what Arrow and the C library hold free in this process."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def returning(run: Callable) -> Callable:
    """``run`` over the batches of a task, with ``give_back`` now and then and after the last.

    Python workers stay for later tasks, also idle ones, and memory that they
    hold free counts as the executor's.
    """

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[pa.RecordBatch]:
            size = 0
            for batch in batches:
                size += batch.nbytes
                yield batch
                if size >= RETURN_BYTES:
                    give_back()
                    size = 0

        yield from run(given())
        give_back()

    return whole


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; see ``discard``."""
    path = run_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``stored`` gave and that no later result reads."""
    for table in tables:
        if table is not None:
            delete_folder(table.sparkSession, table.stored_path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store Spark names it in."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration()
    folder.getFileSystem(conf).delete(folder, True)
