"""Repeated runs of lines, found by a suffix array built by prefix doubling.

A text is a sequence of line hashes. Suffixes are ranked by their first line,
then by their first 2, 4, 8 ... lines: the rank over ``2 n`` lines is the rank
over ``n`` lines refined by that of the suffix ``n`` lines on. A suffix whose
rank nobody shares leaves, so the tables shrink quickly. Suffixes that agree
over a run of ``m`` lines are an interval of the suffix array whose longest
common prefixes are ``m`` at least; two overlapping ranks over a power of two
name it. The first of an interval stays, the later copies of the run go.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType
from pyspark.sql.window import Window

from flowscore.llm.hashing import SPACED, id_filter, parted, span_hashes, text_chunks, words
from flowscore.llm.scratch import bounded_batches, discard, returning, stored

MIN_WORDS = 50
ROW = ["doc", "version"]
_LINES = "doc bigint, version bigint, pos int, h bigint, forward int, backward int"


def _line_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every line, and the number of lines of each text."""
    ends = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([bounds[:-1], ends + 1]))
    stops = np.sort(np.concatenate([ends, bounds[1:]]))
    per_text = 1 + np.diff(np.searchsorted(ends, bounds))
    return starts, stops, per_text


def _windows(counts: np.ndarray, per_text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines of the shortest runs of ``least`` words from each line on, and up to it; 0: none."""
    total = np.concatenate([[0], np.cumsum(counts)])
    line = np.arange(len(counts))
    last = np.repeat(np.cumsum(per_text), per_text)
    first = last - np.repeat(per_text, per_text)
    end = np.searchsorted(total, total[:-1] + least, "left")
    forward = np.where(end <= last, end - line, 0)
    begin = np.searchsorted(total, total[1:] - least, "right") - 1
    backward = np.where((begin >= first) & (total[1:] >= least), line + 1 - begin, 0)
    return forward, backward


def line_rows(docs: DataFrame, least: int) -> DataFrame:
    """A row for every line of every text that is not null."""

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc").to_numpy()
            version = batch.column("version").to_numpy()
            for low, data, bounds in text_chunks(batch.column("text")):
                starts, stops, per_text = _line_bounds(data, bounds)
                h = span_hashes(data, starts, stops)
                _, at, _ = words(data, bounds, SPACED)
                counts = np.bincount(
                    np.searchsorted(starts, at, "right") - 1, minlength=len(starts)
                )
                forward, backward = _windows(counts, per_text, least)
                row = low + np.repeat(np.arange(len(per_text)), per_text)
                pos = np.arange(len(starts)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc[row]),
                        pa.array(version[row]),
                        pa.array(pos.astype(np.int32)),
                        pa.array(h.astype(np.int64)),
                        pa.array(forward.astype(np.int32)),
                        pa.array(backward.astype(np.int32)),
                    ],
                    names=["doc", "version", "pos", "h", "forward", "backward"],
                )

    keyed = docs.where("text IS NOT NULL").select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc"),
        F.xxhash64("text").alias("version"),
        "text",
    )
    return keyed.mapInArrow(run, _LINES)


def doubled(ranks: DataFrame, length: int) -> DataFrame:
    """Ranks over ``2 * length`` lines, of the suffixes that still share theirs.

    A rank is ``(h, sub)``: the hash of the first line, and how many suffixes
    with this first line come before in the order so far.
    """
    right = ranks.select(
        *ROW, (F.col("pos") - length).alias("pos"), F.col("h").alias("h2"), F.col("sub").alias("sub2")
    )
    pairs = ranks.join(right, [*ROW, "pos"])
    groups = pairs.groupBy("h", "sub", "h2", "sub2").agg(F.count("*").alias("n"))
    before = Window.partitionBy("h", "sub").orderBy("h2", "sub2").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = groups.withColumn("place", F.col("sub") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    shared = placed.where("n > 1").select("h", "sub", "h2", "sub2", "place")
    out = pairs.join(shared, ["h", "sub", "h2", "sub2"])
    return out.select(*ROW, "pos", "h", F.col("place").alias("sub"))


def later_copies(ranks: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """Those of the runs (``start, size`` with length <= size < 2 length) that came before.

    Members of one interval are equal runs; all but the first by document and
    place are later copies.
    """
    left = ranks.select(*ROW, F.col("pos").alias("start"), "h", "sub")
    right = ranks.select(
        *ROW, F.col("pos").alias("last"), F.col("h").alias("h2"), F.col("sub").alias("sub2")
    )
    named = runs.withColumn("last", F.col("start") + F.col("size") - length)
    named = named.join(left, [*ROW, "start"]).join(right, [*ROW, "last"])
    interval = ["h", "sub", "h2", "sub2", "size"]
    first = F.min(F.struct(*ROW, "start")).alias("first")
    intervals = named.groupBy(*interval).agg(first, F.count("*").alias("n")).where("n > 1")
    met = named.join(intervals.select(*interval, "first"), interval)
    return met.where(F.struct(*ROW, "start") > F.col("first")).select(*ROW, "start", "size")


def repeated_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``doc, version, removed``: sorted places of the lines that go, for texts with any."""
    every = stored(line_rows(docs, least), "lines")
    lines = every.distinct()
    shared = lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    again = stored(lines.join(shared, "h"), "lines")
    discard(every)
    ranks = again.select(*ROW, "pos", "h", F.lit(0).cast("bigint").alias("sub"))
    forward = again.select(*ROW, F.col("pos").alias("start"), F.col("forward").alias("size"))
    backward = again.select(
        *ROW, (F.col("pos") - F.col("backward") + 1).alias("start"), F.col("backward").alias("size")
    )
    runs = stored(forward.unionByName(backward).where("size > 0").distinct(), "runs")
    powers = runs.select((F.length(F.bin("size")) - 1).alias("power")).distinct().collect()
    powers = {row["power"] for row in powers}
    found, tables = [], [again, runs]
    for power in range(max(powers, default=-1) + 1):
        length = 1 << power
        if power:
            ranks = stored(doubled(ranks, length // 2), "ranks")
            tables.append(ranks)
            if ranks.isEmpty():
                break
        if power in powers:
            sized = runs.where((F.col("size") >= length) & (F.col("size") < 2 * length))
            # Stored one by one: the driver never holds one plan of all lengths.
            found.append(stored(later_copies(ranks, sized, length), "copies"))
    tables += found
    found = functools.reduce(DataFrame.unionByName, found, runs.limit(0))
    place = F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")
    places = stored(found.select(*ROW, place).distinct(), "places")
    discard(*tables)
    return places.groupBy(*ROW).agg(F.array_sort(F.collect_list("pos")).alias("removed"))


def dedup_lines(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later copies of repeated runs of lines taken out of ``text``.

    Lines end at line feeds. A run of lines of at least ``least`` words
    (separated by white space) that occurs again, in this or another text, is
    kept where it occurs first, by doc_id (null first) and place, and taken out
    elsewhere; shorter runs stay. A later copy may overlap the first, as where one
    line stands many times: the lines that both hold are then taken out too. Columns ``n_lines`` and ``removed`` (places
    from 0) are added, replacing any of that name; all others, repeated rows
    included, are passed through. Null text stays null and has no lines, empty
    text is one empty line; a text may lose all lines and is empty then. Rows of
    equal doc_id and text count as one text. No rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("n_lines", "removed")]
    own = docs.select(*kept).withColumns(
        {
            "_doc": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))),
            "_version": F.xxhash64("text"),
        }
    )
    gone = repeated_lines(docs, least).select(
        F.col("doc").alias("_doc"), F.col("version").alias("_version"), F.col("removed").alias("_gone")
    )
    # Only texts that may have lost lines are shuffled.
    rest, touched = parted(own, id_filter(gone.select(F.col("_doc").alias("doc_id"))), "_doc")
    joined = touched.join(gone.hint("merge"), ["_doc", "_version"], "left").select(*kept, "_gone")
    nothing = F.lit(None).cast("array<int>").alias("_gone")
    joined = joined.unionByName(rest.select(*kept, nothing))
    at = kept.index("text")
    schema = docs.select(*kept).schema.add("n_lines", LongType())
    schema = schema.add("removed", ArrayType(IntegerType()))

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, removed = [], [], []
            for text, gone in zip(batch.column(at), batch.column(len(kept)), strict=True):
                text, gone = text.as_py(), gone.as_py() or []
                sizes.append(0 if text is None else text.count("\n") + 1)
                removed.append(gone)
                if gone:
                    away = set(gone)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in away)
                texts.append(text)
            columns = [batch.column(i) for i in range(len(kept))]
            columns[at] = pa.array(texts, pa.string())
            columns += [pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_lines", "removed"])

    return joined.mapInArrow(run, schema)
