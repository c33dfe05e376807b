"""Datasets at rest, read as a table or as a stream; the suffix names the format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SUFFIXES = ("csv", "parquet")


def dataset_name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def _format_of(path: str, fmt: str | None = None) -> str:
    suffix = fmt or dataset_name(path).rsplit(".", 1)[-1]
    if suffix not in SUFFIXES:
        raise ValueError(f"dataset {path!r} has none of the suffixes {SUFFIXES}")
    return suffix


def read_dataset(
    spark: SparkSession, path: str, schema: StructType | None = None, fmt: str | None = None
) -> DataFrame:
    """Batch scan. Csv has no schema of its own, so one must be given.

    A path without one of the suffixes is read as parquet unless ``fmt`` says
    otherwise.

    With a schema, parquet columns outside it are never read and columns the
    files lack come back null.
    """
    suffix = dataset_name(path).rsplit(".", 1)[-1]
    fmt = _format_of(path, fmt or (suffix if suffix in SUFFIXES else "parquet"))
    if schema is None:
        if fmt == "csv":
            raise ValueError(f"csv dataset {path!r} needs a schema")
        return spark.read.parquet(path)
    return spark.read.schema(schema).format(fmt).load(path)


def _stream_path(spark: SparkSession, path: str) -> str:
    # A streaming file source takes a folder or a pattern. A folder stays as it
    # is: only then do its commit log and partition columns count. One file is
    # written as a pattern that matches only itself.
    path = path.rstrip("/")
    if any(mark in path for mark in "*?[{"):
        return path
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    one_file = store.exists(place) and store.getFileStatus(place).isFile()
    return f"{path[:-1]}[{path[-1]}]" if one_file else path


def stream_dataset(
    spark: SparkSession,
    path: str,
    schema: StructType,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: str | None = None,
) -> DataFrame:
    """Streaming scan of a file or folder.

    The two limits bound a micro-batch, so that the first one over a large
    folder is not the whole folder.
    """
    reader = spark.readStream.schema(schema).format(_format_of(path))
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    return reader.load(_stream_path(spark, path))
