"""Samples, splits and partition counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscore.functions.names import column, quote_all

HEX_RANGE = 16**8
# Copies of one row that a task writes out at a time.
COPIES_A_BLOCK = 1 << 20


def bernoulli_sample(df: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Keep each row with probability ``ratio``.

    Repeatable for one seed as long as the partitions are the same. Two samples
    of one table overlap; use ``hash_split`` for disjoint parts.
    """
    return df.sample(withReplacement=False, fraction=float(ratio), seed=int(seed))


def _key_digits(keys: Sequence[str], seed: int) -> Column:
    """Eight hex digits of a digest of seed and key."""
    # A null key part is hashed as an empty text: every row falls on one side.
    parts = [F.coalesce(column(key).cast("string"), F.lit("")) for key in keys]
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 8)


def content_sample(df: DataFrame, ratio: float, seed: int = 42) -> DataFrame:
    """Keep each row with probability ``ratio``, whatever the partitions are.

    The draw is by a digest of seed, content and, for the i-th of several equal
    rows, i: equal rows are drawn apart, and it does not matter which is which.
    Equal rows are counted before the shuffle, and written out in blocks that are
    dealt by their own number, so that a row with many copies is spread. Rows are
    compared by all columns, which must be ones that can be grouped by.
    """
    if not 0.0 <= ratio <= 1.0:
        raise ValueError(f"ratio {ratio} is outside 0..1")
    bound = round(ratio * HEX_RANGE)
    names = quote_all(df.columns)
    counted = df.groupBy(*names).agg(F.count("*").alias("__n"))
    last = F.expr(f"(__n - 1) DIV {COPIES_A_BLOCK}")
    blocks = counted.withColumn("__block", F.explode(F.sequence(F.lit(0), last)))
    content = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    many = blocks.filter("__n > %d" % COPIES_A_BLOCK).repartition("__block", *names)
    every = blocks.filter("__n <= %d" % COPIES_A_BLOCK).unionByName(many)
    first = F.col("__block") * COPIES_A_BLOCK
    copies = F.sequence(first, F.least(first + COPIES_A_BLOCK, F.col("__n")) - 1)
    drawn = every.withColumn("__digest", F.md5(content)).withColumn("__copy", F.explode(copies))
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "__digest", "__copy")), 1, 8)
    kept = F.conv(digits, 16, 10).cast("bigint") < F.lit(bound)
    return drawn.filter(kept).select(*names)


def _in_first_part(keys: Sequence[str], ratio: float, seed: int) -> Column:
    if not 0.0 <= ratio <= 1.0:
        raise ValueError(f"ratio {ratio} is outside 0..1")
    bound = round(ratio * HEX_RANGE)
    if bound >= HEX_RANGE:
        return F.lit(True)
    return _key_digits(keys, seed) < F.lit(f"{bound:08x}")


def fold_number(keys: str | Sequence[str], folds: int, seed: int = 42) -> Column:
    """A fold from 0 on for each row, from its key and the seed only."""
    if folds < 2:
        raise ValueError(f"there are 2 folds or more, not {folds}")
    keys = [keys] if isinstance(keys, str) else list(keys)
    return (F.conv(_key_digits(keys, seed), 16, 10).cast("bigint") % folds).cast("int")


def hash_split(
    df: DataFrame, keys: str | Sequence[str], ratio: float, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts that together hold every row, about ``ratio`` in the first.

    A row's side depends on its key and the seed only, so it is the same after
    any repartitioning or restart. No shuffle.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    chosen = _in_first_part(keys, ratio, seed)
    return df.filter(chosen), df.filter(~chosen)


def repartition_dataset(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin into ``partitions``.

    Unset, it is twice the default parallelism, however the scan is split: what
    a forest fits hangs on the partitions, so they must not follow the files.
    For a large table give a count that fits the executors' memory.
    """
    if partitions is not None:
        return df.repartition(partitions)
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism * 2)
