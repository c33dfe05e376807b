"""Csv and json payloads as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMATS = ("csv", "json")

# Written times keep their microseconds; reading takes any number of digits.
TIME_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
# Spark's csv writer would otherwise trim texts.
CSV_WRITE_OPTIONS = {
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    **TIME_OPTIONS,
}
# A quoted empty text is a text; only a place with nothing in it is null.
CSV_READ_OPTIONS = {"nullValue": "\u0000"}


def check_format(fmt: str) -> str:
    if fmt not in FORMATS:
        raise ValueError(f"message format {fmt!r} is not one of {FORMATS}")
    return fmt


def parse_payload(
    payload: Column, schema: StructType, fmt: str, options: Mapping[str, str] | None = None
) -> Column:
    """One struct per payload; what cannot be parsed becomes null fields."""
    text = payload.cast("string")
    if check_format(fmt) == "csv":
        return F.from_csv(text, schema.toDDL(), {**CSV_READ_OPTIONS, **(options or {})})
    return F.from_json(text, schema, dict(options or {}))


def build_payload(
    fields: Sequence[str | Column], fmt: str, options: Mapping[str, str] | None = None
) -> Column:
    """One csv or json text per row.

    Csv keeps a place for null fields, quotes separators and does not trim, so
    every field comes back in its own column as it was; json leaves null fields
    out.
    """
    record = F.struct(*fields)
    if check_format(fmt) == "csv":
        return F.to_csv(record, {**CSV_WRITE_OPTIONS, **(options or {})})
    return F.to_json(record, {**TIME_OPTIONS, **(options or {})})
