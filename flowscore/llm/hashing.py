"""64-bit word hashes of whole Arrow text columns, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from flowscore.llm.scratch import returning

_STEP = 0x9E3779B97F4A7C15
_CHUNK_BYTES = 1 << 20
_U = np.uint64


def lowered_words(is_separator: Callable[[int], bool]) -> np.ndarray:
    """Byte table of a word alphabet: 0 ends a word, A-Z count as a-z."""
    table = np.zeros(256, _U)
    for byte in range(256):
        if not is_separator(byte):
            table[byte] = (byte + 32 if 65 <= byte <= 90 else byte) + 1
    return table


# Words of op5: all but space, tab, line feed, vertical tab, form feed, return.
SPACED = lowered_words(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
# Words of op2: ASCII digits and letters, and every byte of other scripts.
ALNUM = lowered_words(
    lambda b: b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F
)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def span_hashes(data: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """One hash for each span of bytes, ``first`` to ``after``; spans ascend.

    Eight bytes at a time are mixed with their place in the span. The sum of what
    comes out is mixed with the length, so no pattern of bytes cancels out.
    """
    widths = (after - first).astype(np.int64)
    blocks = (widths + 7) // 8
    ends = np.cumsum(blocks)
    total = int(ends[-1]) if len(ends) else 0
    nth = np.arange(total) - np.repeat(ends - blocks, blocks)
    begin = np.repeat(first, blocks) + 8 * nth
    left = np.repeat(widths, blocks) - 8 * nth
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    value = np.zeros(total, _U)
    for k in range(8):
        value |= np.where(left > k, padded[begin + k], 0).astype(_U) << _U(8 * k)
    value = mix(mix(value) + (nth.astype(_U) + _U(1)) * _U(_STEP))
    sums = np.zeros(total + 1, _U)
    np.cumsum(value, out=sums[1:])
    return mix(sums[ends] - sums[ends - blocks] + widths.astype(_U) * _U(_STEP))


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row bounds within the bytes) for runs of whole texts.

    A run holds about 1 MB, more only if one text alone is longer. Null is empty.
    """
    binary = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(binary.buffers()[1], np.int64)[
        binary.offset : binary.offset + len(binary) + 1
    ]
    data = binary.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(binary):
        high = int(np.searchsorted(offsets, offsets[low] + _CHUNK_BYTES, "right")) - 1
        high = min(max(high, low + 1), len(binary))
        yield low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def words(
    data: np.ndarray, bounds: np.ndarray, table: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, row) of every word, in order; words end where a row ends."""
    n = len(data)
    codes = table[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    on = np.zeros(n + 2, bool)
    on[1:-1] = codes != 0
    first = np.flatnonzero(on[1:-1] & (~on[:-2] | cut[:-1]))
    after = np.flatnonzero(on[1:-1] & (~on[2:] | cut[1:])) + 1
    hashes = span_hashes((codes - _U(1)).astype(np.uint8), first, after)
    return hashes, first, np.searchsorted(bounds, first, "right") - 1


def folded(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each sequence of as many hashes as there are parts."""
    out = np.full(len(parts[0]), len(parts), _U)
    for part in parts:
        out = mix(out * _U(3) + part)
    return out


def shingle_sets(column: pa.Array, table: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Per row the sorted distinct hashes of its shingles of ``size`` words.

    A row of fewer words, but not none, has one shingle: all of them.
    """
    for _, data, bounds in text_chunks(column):
        hashes, _, rows = words(data, bounds, table)
        edges = np.searchsorted(rows, np.arange(len(bounds)))
        grams = np.zeros(0, _U)
        if len(hashes) >= size:
            last = len(hashes) - size + 1
            grams = folded([hashes[i : i + last] for i in range(size)])
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if high - low >= size:
                yield np.unique(grams[low : high - size + 1])
            elif high > low:
                yield folded([hashes[i : i + 1] for i in range(low, high)])
            else:
                yield hashes[:0]


FILTER_BITS = 1 << 23


def id_filter(ids: DataFrame) -> np.ndarray:
    """A filter of fixed size, 1 MiB, over a column of integers named ``doc_id``.

    It passes every id given and some others (fewer than 1 in 8 up to a million
    ids), so a join must follow; it only spares that join most of its shuffle.
    """
    rows = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit"))
    rows = rows.selectExpr("CAST(bit DIV 8 AS INT) AS byte", "shiftleft(1, CAST(bit % 8 AS INT)) AS bits")
    rows = rows.groupBy("byte").agg(F.bit_or("bits").cast("short").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    out[rows.column("byte").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint8)
    return out


def passing(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """``doc_id, text`` of the documents that ``id_filter`` lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("bit").to_numpy(zero_copy_only=False).astype(np.int64)
            hit = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            yield batch.select(["doc_id", "text"]).filter(pa.array(hit.astype(bool)))

    known = docs.select(F.col("doc_id").cast("bigint"), "text").where("doc_id IS NOT NULL")
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit")
    return known.select("doc_id", "text", bit).mapInArrow(run, "doc_id bigint, text string")


def parted(docs: DataFrame, bits: np.ndarray, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` the filter stops, and rows that pass: only these need a join.

    A null key passes. All columns are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    names = docs.columns
    schema = StructType([*docs.schema.fields, StructField("_passes", BooleanType())])

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            passes = pa.array(hit.astype(bool) | (at < 0))
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, passes], names=[*names, "_passes"])

    bit = F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.lit(FILTER_BITS)))
    flagged = docs.select("*", bit.alias("_bit")).mapInArrow(run, schema)
    return flagged.where("NOT _passes").drop("_passes"), flagged.where("_passes").drop("_passes")
