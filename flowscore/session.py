"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

import pyspark
from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH = "flowscore.scratch.dir"


def kafka_package() -> str:
    """Maven coordinates of the Kafka connector that fits the running Spark."""
    return f"org.apache.spark:spark-sql-kafka-0-10_2.13:{pyspark.__version__}"


def build_session(app_name: str, kafka: bool = False, **conf: str) -> SparkSession:
    """Session with wide plans printed whole; ``kafka`` adds the connector.

    Sizing (executors, memory, shuffle partitions) is left to the caller or to
    ``spark-submit``: nothing here overrides a cluster's own settings.
    """
    builder = SparkSession.builder.appName(app_name).config(
        "spark.sql.debug.maxToStringFields", "100"
    )
    if kafka:
        builder = builder.config("spark.jars.packages", kafka_package())
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, as the session names it.

    ``spark.checkpoint.dir`` wins. Only a local master, where driver and
    executors are one process, may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_LOCAL_SCRATCH, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="flowscore-")
    spark.conf.set(_LOCAL_SCRATCH, folder)
    return folder


def run_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/flowscore/{label}-{uuid.uuid4().hex}"


def stage_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: what follows can read the result several times, and a
    lost executor costs a re-read, not a recomputation.
    """
    path = run_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
