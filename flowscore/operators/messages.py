"""Records to messages and back, and the check that a record is complete."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowscore.functions.names import column, quote_all
from flowscore.functions.payloads import build_payload, parse_payload
from flowscore.sources.schemas import required_fields

# Metadata columns of a message.
METADATA = ("partition", "offset", "timestamp")


def decode_messages(
    messages: DataFrame,
    schema: StructType,
    fmt: str = "csv",
    meta: str = "_meta",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Parse ``value`` into the schema's columns.

    The message's own columns go into the struct ``meta``, where they cannot
    clash with a record field of the same name.
    """
    _check_names(schema, meta)
    return _decoded(messages, schema, fmt, meta, options)


def _check_names(schema: StructType, *names: str) -> None:
    for name in names:
        if name in schema.fieldNames():
            raise ValueError(f"schema has a field named {name!r}; pass another name, e.g. for meta")


def _decoded(
    messages: DataFrame,
    schema: StructType,
    fmt: str,
    meta: str,
    options: Mapping[str, str] | None,
    *more: Column,
) -> DataFrame:
    record = parse_payload(F.col("value"), schema, fmt, options)
    present = [name for name in METADATA if name in messages.columns]
    extra = [F.struct(*present).alias(meta)] if present else []
    # Flattened by a generator over one record, not by ``record.*``: a filter on
    # record fields would move below the latter and parse the payload again for
    # every field it tests.
    return messages.select(F.inline(F.array(record)), *extra, *more)


def check_messages(
    messages: DataFrame,
    schema: StructType,
    fmt: str = "csv",
    meta: str = "_meta",
    reason: str = "_reason",
    payload: str = "_payload",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """``decode_messages`` and, for records that cannot be scored, why, and what was sent.

    ``reason`` is null for a record that fills every required field, else
    ``no field could be read`` or ``missing: a, b``, in the schema's order. Only
    rejected records keep their payload, as text.
    """
    _check_names(schema, meta, reason, payload)
    text = F.col("value").cast("string").alias(payload)
    decoded = _decoded(messages, schema, fmt, meta, options, text)
    required = required_fields(schema)
    if not required:
        why = F.lit(None).cast("string")
    else:
        nothing = reduce(and_, [column(name).isNull() for name in schema.fieldNames()])
        names = [F.when(column(name).isNull(), F.lit(name)) for name in required]
        missing = F.concat(F.lit("missing: "), F.concat_ws(", ", *names))
        why = F.when(nothing, "no field could be read").when(~_complete(schema), missing)
    checked = decoded.withColumn(reason, why)
    return checked.withColumn(payload, F.when(column(reason).isNotNull(), column(payload)))


def encode_messages(
    df: DataFrame,
    fmt: str = "csv",
    keep: Sequence[str] = (),
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """All columns outside ``keep`` as one text column ``value``."""
    fields = quote_all(name for name in df.columns if name not in keep)
    return df.select(*quote_all(keep), build_payload(fields, fmt, options).alias("value"))


def _complete(schema: StructType) -> Column | None:
    filled = [column(name).isNotNull() for name in required_fields(schema)]
    return reduce(and_, filled) if filled else None


def keep_complete(df: DataFrame, schema: StructType) -> DataFrame:
    """Rows that fill every required field; all rows when none is required."""
    condition = _complete(schema)
    return df if condition is None else df.filter(condition)


def rejected_rows(df: DataFrame, schema: StructType) -> DataFrame:
    """The rows ``keep_complete`` drops, for a dead-letter table."""
    condition = _complete(schema)
    return df.filter(F.lit(False) if condition is None else ~condition)
