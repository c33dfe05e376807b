"""References to columns whose names may hold dots or backticks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def quote_all(names: Iterable[str]) -> list[str]:
    return [quoted(name) for name in names]


def column(name: str) -> Column:
    return F.col(quoted(name))
