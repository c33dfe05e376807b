"""Consecutive row numbers, and pages of equal size, without a single-task sort.

Rows are range-partitioned by the order key and sorted inside each partition.
A row's number is the count of rows in earlier partitions plus its place in its
own; only the counts, one per shuffle partition, pass through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DateType,
    MapType,
    NumericType,
    StringType,
    StructType,
    TimestampNTZType,
    TimestampType,
    VariantType,
)

from flowscore.functions.names import column, quote_all
from flowscore.session import stage_table

# Bits of monotonically_increasing_id below the partition number.
SLOT_BITS = 33

# Cells of the histogram that finds where the first rows end.
CUTOFF_CELLS = 4096

# Times the histogram is refined.
CUTOFF_ROUNDS = 3

# Bytes of a text that place it in a cell: as many as a double tells apart.
PREFIX_BYTES = 6


def _order_columns(df: DataFrame, order_by: Sequence[str], shuffle_seed: int | None):
    keys = [column(name) for name in order_by]
    if shuffle_seed is None:
        return keys
    return [F.xxhash64(F.lit(shuffle_seed), *keys), *keys]


def _measure(lead: Column, kind: DataType) -> Column | None:
    """A double that never decreases in ``lead``; ``None`` for kinds without one."""
    if isinstance(kind, NumericType):
        return lead.cast("double")
    if isinstance(kind, TimestampType):
        return F.unix_micros(lead).cast("double")
    if isinstance(kind, (DateType, TimestampNTZType)):
        return F.unix_date(lead.cast("date")).cast("double")
    if kind == StringType():
        start = F.hex(F.substring(F.encode(lead, "UTF-8"), 1, PREFIX_BYTES))
        return F.conv(F.rpad(start, 2 * PREFIX_BYTES, "0"), 16, 10).cast("double")
    return None


def _at_most(lead: Column, kind: DataType, measure: Column, top: Row) -> Column:
    """Is ``lead`` in the cell of ``top`` or before it? As the file scan takes it, if it can be."""
    if isinstance(kind, (NumericType, StringType)):
        return lead <= F.lit(top.value)
    if isinstance(kind, TimestampType):
        # Not from the measure: a double is too coarse for times after the year 2255.
        return lead <= F.timestamp_micros(F.lit(top.micros))
    if isinstance(kind, DateType):
        return lead <= F.date_from_unix_date(F.lit(int(top.measure)))
    return measure <= F.lit(top.measure)


def _before_cutoff(df: DataFrame, lead: Column, first: int) -> DataFrame:
    """Drop rows that cannot be among the ``first`` lowest by ``lead``.

    A superset of the wanted rows is left, so this saves work and never changes
    a result. A few far values can make one round's histogram coarse; later
    rounds look only at what the one before has left. Booleans, binaries and
    nested keys are left to the sort.
    """
    kind = df.select(lead).schema[0].dataType
    measure = _measure(lead, kind)
    narrowed = measure is not None
    rounds = 0
    while narrowed and rounds < CUTOFF_ROUNDS:
        df, narrowed = _cut_once(df, lead, kind, measure, first)
        rounds += 1
    return df


def _cut_once(
    df: DataFrame, lead: Column, kind: DataType, measure: Column, first: int
) -> tuple[DataFrame, bool]:
    """One round, and whether another may be worth it.

    Two scans of one column count the rows per histogram cell; what lies above
    the cell where the count reaches ``first`` goes. Cells are in the order of
    the sort: null, minus infinity, finite values, infinity, NaN.
    """
    endless = float("inf")
    finite = F.when(F.abs(measure) < F.lit(endless), measure)
    low, high = df.agg(F.min(finite), F.max(finite)).first()
    if low is None:
        low = high = 0.0
    inner = F.width_bucket(measure, F.lit(low), F.lit(high), F.lit(CUTOFF_CELLS))
    cell = (
        F.when(measure.isNull(), -1)
        .when(F.isnan(measure), CUTOFF_CELLS + 3)
        .when(measure == F.lit(endless), CUTOFF_CELLS + 2)
        .when(measure == F.lit(-endless), 0)
        .otherwise(F.coalesce(inner, F.lit(1).cast("long")))
    )
    # A time is carried as a whole number: Python's own may not hold it.
    is_time = isinstance(kind, TimestampType)
    cells = df.groupBy(cell.cast("long").alias("cell")).agg(
        F.count("*").alias("n"),
        F.max(F.lit(None) if is_time else lead).alias("value"),
        F.max(F.unix_micros(lead) if is_time else F.lit(None)).alias("micros"),
        F.max(measure).alias("measure"),
    )
    reached = (
        cells.select("cell", "value", "micros", "measure", F.sum("n").over(W.orderBy("cell")).alias("upto"))
        .filter(F.col("upto") >= first)
        .orderBy("cell")
        .first()
    )
    if reached is None:
        return df, False
    if reached.cell == -1:
        return df.filter(lead.isNull()), False
    left = df.filter(lead.isNull() | _at_most(lead, kind, measure, reached))
    return left, reached.upto > 2 * first and -endless < reached.measure < high


def _sorted_slots(placed: DataFrame, total_order: Sequence[Column], names: Sequence[str]):
    """Range-partition and sort; ``__slot`` holds the partition and the place in it."""
    return (
        placed.repartitionByRange(*total_order)
        .sortWithinPartitions(*total_order)
        .select(*quote_all(names), F.monotonically_increasing_id().alias("__slot"))
    )


def _hashable(kind: DataType) -> bool:
    """Maps have no hash; the source position orders what they alone tell apart."""
    if isinstance(kind, StructType):
        return all(_hashable(field.dataType) for field in kind.fields)
    if isinstance(kind, ArrayType):
        return _hashable(kind.elementType)
    return not isinstance(kind, (MapType, VariantType))


def _placed(df: DataFrame) -> DataFrame:
    """Add what orders rows of equal keys.

    A key shared by many rows, or many copies of one row, would land in one
    range; the content hash and the source position split both.
    """
    hashed = [f.name for f in df.schema.fields if _hashable(f.dataType)]
    return df.withColumns(
        {
            "__content": F.xxhash64(*quote_all(hashed)) if hashed else F.lit(0).cast("bigint"),
            "__source": F.monotonically_increasing_id(),
        }
    )


def number_rows(
    df: DataFrame,
    order_by: Sequence[str],
    index: str = "row_no",
    first: int | None = None,
    shuffle_seed: int | None = None,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``index`` = 0, 1, 2, ... in the order of ``order_by`` (nulls first).

    ``first`` keeps that many rows. ``shuffle_seed`` orders by a seeded hash of
    the key instead. ``carry`` names the columns to keep (all); the others are
    left out of the sort. Rows with equal keys are ordered by their content, so
    the result depends on the data only. Runs a job when called: the sorted
    rows are written to the shared folder, because numbering reads them twice
    and must see the same partitions both times.

    ``df`` should be read from files: full copies of a row are told apart by
    source position, which is then the same when a lost task is run again.
    Anything else, pass through ``session.stage_table`` first.
    """
    keys = _order_columns(df, order_by, shuffle_seed)
    wanted = _before_cutoff(df, keys[0], first) if first else df
    placed = _placed(wanted)
    total_order = [*keys, F.col("__content"), F.col("__source")]
    names = df.columns if carry is None else list(carry)
    needed = dict.fromkeys([*names, *order_by, "__content", "__source"])
    placed = placed.select(*quote_all(needed))
    staged = stage_table(_sorted_slots(placed, total_order, names), "numbered")

    part = F.shiftright("__slot", SLOT_BITS)
    place = F.col("__slot") - F.shiftleft(part, SLOT_BITS)
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        staged.groupBy(part.alias("__part"))
        .count()
        .select("__part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__start"))
    )
    numbered = staged.withColumn("__part", part).join(starts, "__part")
    result = numbered.select((F.col("__start") + place).alias(index), *quote_all(names))
    return result if first is None else result.filter(column(index) < first)


def number_by_position(
    df: DataFrame,
    index: str = "row_no",
    starts: DataFrame | None = None,
    files: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``index`` = 0, 1, 2, ... in the order the rows are stored: by file path, then place.

    ``df`` is read from parquet files, whose rows have a place in their file.
    Nothing but one count per file is shuffled, nothing is written, and the
    numbers are the same whatever tasks read the files. ``starts`` are those of
    ``file_starts``, if they are known; ``files`` names the only files to read.
    """
    starts = (file_starts(df) if starts is None else starts).select("__file", "__start")
    place = F.col("_metadata.row_index")
    wanted = df if files is None else df.filter(_file().isin(list(files)))
    placed = wanted.select(*quote_all(df.columns), _file().alias("__file"), place.alias("__place"))
    numbered = placed.join(F.broadcast(starts) if _few(starts) else starts, "__file")
    return numbered.select(
        (F.col("__start") + F.col("__place")).alias(index), *quote_all(df.columns)
    )


# Files whose starts are sent to every executor; beyond, Spark chooses the join.
BROADCAST_FILES = 100_000


def _few(starts: DataFrame) -> bool:
    return starts.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES


def _file() -> Column:
    return F.col("_metadata.file_path")


def file_starts(df: DataFrame) -> DataFrame:
    """``__file, __start, __rows`` of the files of ``df``, in the order of their paths."""
    counts = df.select(_file().alias("__file")).groupBy("__file").agg(F.count("*").alias("__rows"))
    before = W.orderBy("__file").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("__rows").over(before), F.lit(0))
    return counts.select("__file", start.alias("__start"), "__rows")


def sorted_table(
    df: DataFrame, order_by: Sequence[str], first: int | None = None, shuffle_seed: int | None = None
) -> DataFrame:
    """The rows in the order of ``number_rows``, written once: ``number_by_position`` numbers them."""
    keys = _order_columns(df, order_by, shuffle_seed)
    placed = _placed(_before_cutoff(df, keys[0], first) if first else df)
    total_order = [*keys, F.col("__content"), F.col("__source")]
    spread = placed.repartitionByRange(*total_order).sortWithinPartitions(*total_order)
    return stage_table(spread.select(*quote_all(df.columns)), "sorted")


def paginate(
    df: DataFrame,
    rows: int,
    order_by: Sequence[str],
    pages: int | None = None,
    shuffle_seed: int | None = None,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``row_no`` and ``batch_no``: pages of ``rows`` rows, the first ``pages`` of them."""
    if rows <= 0:
        raise ValueError(f"rows per page must be positive, not {rows}")
    first = None if pages is None else rows * pages
    numbered = number_rows(df, order_by, first=first, shuffle_seed=shuffle_seed, carry=carry)
    return numbered.selectExpr(f"row_no DIV {int(rows)} AS batch_no", "*")
