"""Near-duplicate documents: fast similarity sketches, banding, exact verification.

A sketch of ``t`` coordinates is filled in rounds. In round ``i < t`` every
element of the set is placed in one hashed bin with value ``i + fraction``; in
round ``t + j`` every element goes to bin ``j``. A bin keeps its smallest
value, so rounds can stop once no bin is empty, which the later rounds force
after ``2 t`` at most, and coordinates agree with the Jaccard similarity with
the concentration of that many independent minimums. (Dahlgaard, Knudsen,
Thorup: Fast Similarity Sketching.)
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscore.llm.graph import components
from flowscore.llm.hashing import SPACED, id_filter, mix, passing, shingle_sets
from flowscore.llm.scratch import discard, returning, stored

_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
_ROUND_SHIFT = _U(54)
_AT_ONCE = 4096
SKETCH_SCHEMA = "doc_id bigint, n_shingles bigint, n_bytes bigint, key binary, bands array<bigint>"


@dataclass(frozen=True)
class NearRule:
    """What counts as near: shingle length in words, similarity as a percentage.

    ``bands`` bands of ``rows`` coordinates: with the defaults a pair at 80 % is
    missed with a chance of 6e-5, one at 85 % with 3e-7.
    ``block_bytes``: text that one task of the crowded buckets takes at once.
    """

    size: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 6
    block_bytes: int = 4 << 20


def sketch(elements: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` coordinates of a set of 64-bit hashes; not for an empty set."""
    bins = np.full(width, _EMPTY)
    step = max(1, min(width, _AT_ONCE // len(elements)))
    for first in range(0, 2 * width, step):
        rounds = np.arange(first, min(first + step, 2 * width), dtype=_U)
        draws = mix(elements[None, :] ^ mix(rounds + _U(1))[:, None])
        place = ((draws >> _U(32)) * _U(width)) >> _U(32)
        forced = rounds >= width
        place[forced] = (rounds[forced] - _U(width))[:, None]
        values = (rounds[:, None] << _ROUND_SHIFT) | (mix(draws) >> _U(10))
        np.minimum.at(bins, place.ravel().astype(np.int64), values.ravel())
        if not (bins == _EMPTY).any():
            break
    return bins


def band_keys(bins: np.ndarray, rule: NearRule) -> np.ndarray:
    """One 64-bit key for each band."""
    table = bins.reshape(rule.bands, rule.rows)
    keys = np.arange(rule.bands, dtype=_U)
    for i in range(rule.rows):
        keys = mix(keys * _U(5) + table[:, i])
    return keys


def sketches(docs: DataFrame, rule: NearRule) -> DataFrame:
    """Size of the shingle set, a 128-bit key of it, and the band keys, per document."""

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            sizes, keys, bands = [], [], []
            for s in shingle_sets(texts, SPACED, rule.size):
                sizes.append(len(s))
                if len(s):
                    both = np.array([mix(s).sum(), mix(s ^ _U(0xA5A5A5A5)).sum()], _U)
                    keys.append(both.tobytes())
                    found = band_keys(sketch(s, rule.bands * rule.rows), rule)
                    bands.append(found.astype(np.int64))
                else:
                    keys.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(
                        [len(x.as_buffer()) if x.is_valid else 0 for x in texts], pa.int64()
                    ),
                    pa.array(keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "n_bytes", "key", "bands"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SKETCH_SCHEMA)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Is 100 * |a & b| >= percent * |a | b|, for sorted distinct hashes?"""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(few) < percent * len(many):
        return False
    at = np.searchsorted(many, few)
    at[at == len(many)] = 0
    both = int((many[at] == few).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, rule: NearRule) -> DataFrame:
    """Those of the pairs ``(a, b)`` whose full shingle sets are near enough.

    Texts join the pairs, so a leader with very many members is split by the
    skew join, and no task holds more than one pair at a time.
    """

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = (None, None)
            keep = []
            leaders = batch.column("a").to_pylist()
            for i, s in enumerate(shingle_sets(batch.column("b_text"), SPACED, rule.size)):
                if known[0] != leaders[i]:
                    one = batch.column("a_text").slice(i, 1)
                    known = (leaders[i], next(shingle_sets(one, SPACED, rule.size)))
                if _linked(known[1], s, rule.percent):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a bigint, b bigint")


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members of buckets with the component they belong to so far."""
    labels = found.withColumnRenamed("node", "doc_id")
    return members.join(labels, "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")
    )


def _blocks(crowd: DataFrame, clusters: DataFrame, rule: NearRule) -> DataFrame:
    """Documents of crowded clusters, dealt to pairs of blocks of bounded size.

    Every pair of a cluster's documents meets in exactly one task: block ``x``
    of a document is by hash, and task ``(x, y)`` gets blocks ``x <= y``.
    """
    placed = crowd.join(clusters, crowd.component == clusters.node).select(
        "doc_id", crowd.component, "bands", "n_bytes", clusters.component.alias("cluster")
    )
    total = placed.groupBy("cluster").agg(F.sum(F.col("n_bytes") + 400).alias("bytes"))
    count = F.ceil(F.col("bytes") / F.lit(rule.block_bytes)).cast("int")
    block = F.pmod(F.xxhash64("doc_id"), F.col("count")).cast("int")
    dealt = placed.join(total.select("cluster", count.alias("count")), "cluster")
    dealt = dealt.withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("count") - 1))
    )
    return dealt.withColumn(
        "task", F.xxhash64("cluster", F.least("block", "other"), F.greatest("block", "other"))
    ).withColumn("low", F.col("block") <= F.col("other"))


def _block_links(dealt: DataFrame, texts: DataFrame, rule: NearRule) -> DataFrame:
    """Links that join different components, found inside each pair of blocks.

    Pairs that share no band, or whose components have met already in this
    task, are passed over; what comes out is a forest, not all pairs.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("doc_id")
        ids = table.column("doc_id").to_pylist()
        texts_of = table.column("text").combine_chunks()
        sets = list(shingle_sets(texts_of, SPACED, rule.size))
        width = rule.bands
        flat = table.column("bands").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        bands = flat.reshape(len(ids), width)
        labels = np.array(table.column("component").to_pylist(), np.int64)
        a, b = [], []
        for i in range(1, len(ids)):
            while True:
                apart = np.flatnonzero(labels[:i] != labels[i])
                apart = apart[(bands[apart] == bands[i]).any(axis=1)]
                for j in apart:
                    if _linked(sets[j], sets[i], rule.percent):
                        a.append(ids[i])
                        b.append(ids[int(j)])
                        labels[labels == labels[i]] = labels[j]
                        break
                else:
                    break
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = dealt.join(texts, "doc_id").select("task", "doc_id", "component", "bands", "text")
    # A document meets itself in the task of its own block only.
    return rows.distinct().groupBy("task").applyInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, rule: NearRule) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row for each row of ``docs``.

    Documents are linked if the sets of their ``rule.size``-word shingles are
    near enough; a component is what links reach, named by its smallest doc_id,
    and that document is kept. Text is read whole; null and text without words
    has no shingle and is linked with nothing. Fewer words than a shingle count
    as one shingle. Rows that repeat a doc_id are one node. A null doc_id is
    linked with nothing: its component is null and ``kept`` is true. Other
    columns are ignored. An empty table gives no rows.

    1. Documents of equal sets are one class, named by its smallest doc_id.
    2. Class names that share a band key are compared with the smallest of the
       bucket, on full sets: a row per member, never all pairs.
    3. Buckets whose other members are still in different components are
       clusters left over; their documents are compared exhaustively in blocks
       of bounded size, so that no candidate pair of step 2 goes untested.
    """
    sketched = stored(sketches(docs, rule), "sketches")
    named = sketched.where("doc_id IS NOT NULL AND key IS NOT NULL")
    classes = named.groupBy("key").agg(F.min("doc_id").alias("leader"), F.count("*").alias("n"))
    copies = (
        named.select("doc_id", "key")
        .join(classes.where("n > 1"), "key")
        .select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
        .where("a <> b")
    )
    copies = stored(copies, "copies")
    leaders = named.join(copies.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_anti")
    members = leaders.select("doc_id", F.explode("bands").alias("bucket"))
    crowds = members.groupBy("bucket").agg(
        F.min("doc_id").alias("leader"), F.max("doc_id").alias("last"), F.count("*").alias("n")
    )
    shared = members.join(crowds.where("leader <> last"), "bucket")
    shared = stored(shared, "buckets")
    pairs = shared.select(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
    pairs = stored(pairs.where("a <> b").distinct(), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    asked_texts = passing(docs, id_filter(asked)).join(asked, "doc_id", "left_semi")
    asked_texts = stored(asked_texts, "texts")
    links = stored(verified(pairs, asked_texts, rule), "links")
    stars = components(links)

    # Members but the leader, which has met all others already.
    rest = _labelled(shared.where("doc_id <> leader AND n > 2"), stars)
    open_buckets = (
        rest.groupBy("bucket")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
    )
    crowd = rest.join(open_buckets, "bucket")
    crowd = stored(crowd.select("doc_id", "component", "low").distinct(), "crowd")
    clusters = components(
        crowd.select(F.col("component").alias("a"), F.col("low").alias("b"))
    )
    members_left = (
        crowd.select("doc_id", "component")
        .distinct()
        .join(named.select("doc_id", "bands", "n_bytes"), "doc_id")
        .dropDuplicates(["doc_id"])
    )
    dealt = _blocks(members_left, clusters, rule)
    more = stored(_block_links(dealt, asked_texts, rule), "links")

    found = components(links.unionByName(more).unionByName(copies))
    discard(links, more, copies, shared, pairs, asked_texts, stars, crowd, clusters)
    sized = sketched.select("doc_id", "n_shingles")
    out = sized.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
