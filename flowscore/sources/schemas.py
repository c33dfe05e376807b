"""Schemas kept as json files next to the data."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType


def load_schema(spark: SparkSession, path: str) -> StructType:
    """Read a ``StructType`` from a json file, indented or on one line.

    The file is either a whole struct object or any object with ``fields``.
    """
    (text,) = spark.read.text(path, wholetext=True).first()
    return StructType.fromJson({"type": "struct", "fields": json.loads(text)["fields"]})


def as_schema(spark: SparkSession, schema: str | StructType | None) -> StructType | None:
    """A schema given as such, as the path of its file, or not at all."""
    return load_schema(spark, schema) if isinstance(schema, str) else schema


def required_fields(schema: StructType) -> list[str]:
    """Names declared ``nullable: false``, i.e. that a valid record must fill."""
    return [field.name for field in schema.fields if not field.nullable]
