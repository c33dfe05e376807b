"""Benchmark passages in documents, through a positional inverted index.

The index has a posting (term, document, position) for every occurrence of the
terms that the search starts from: the rarest terms of each benchmark window,
by their counts over all documents. Lists are moved by the term's offset in the
window and intersected, rarest first; what is left is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowscore.llm.hashing import ALNUM, id_filter, passing, text_chunks, words
from flowscore.llm.scratch import discard, returning, stored

WINDOW_WORDS = 10
ANCHORS = 3
# Benchmark words that one pass takes; a larger benchmark takes several passes.
WORDS_AT_ONCE = 1_000_000
_U = np.uint64


def _row_words(column: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each row, in order."""
    for _, data, bounds in text_chunks(column):
        hashes, _, rows = words(data, bounds, ALNUM)
        edges = np.searchsorted(rows, np.arange(len(bounds)))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield hashes[low:high]


def _places(found: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index in the sorted ``terms`` of each hash, and whether it is there."""
    if not len(terms):
        return np.zeros(len(found), np.int64), np.zeros(len(found), bool)
    at = np.searchsorted(terms, found)
    at[at == len(terms)] = 0
    return at, terms[at] == found


class Windows:
    """The distinct windows of a slice of the benchmark, and the items of each."""

    def __init__(self, ids: list, texts: pa.Array, window: int) -> None:
        items: dict[bytes, set[str]] = {}
        for item, found in zip(ids, _row_words(texts), strict=True):
            size = min(window, len(found))
            for start in range(len(found) - size + 1 if size else 0):
                key = found[start : start + size].tobytes()
                items.setdefault(key, set()).add("null" if item is None else str(item))
        self.words = [np.frombuffer(key, _U) for key in items]
        self.items = [sorted(names) for names in items.values()]
        every = np.concatenate(self.words) if self.words else np.zeros(0, _U)
        self.terms = np.unique(every)

    def anchors(self, counts: np.ndarray) -> list[list[tuple[int, int]]]:
        """Per window (offset, term place) of its rarest terms, rarest first."""
        out = []
        for found in self.words:
            places, _ = _places(found, self.terms)
            first = {int(p): i for i, p in reversed(list(enumerate(places)))}
            ranked = sorted(first, key=lambda p: (counts[p], p))[:ANCHORS]
            out.append([(first[p], p) for p in ranked])
        return out


def term_counts(docs: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How often each of the terms occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, data, bounds in text_chunks(batch.column("text")):
                at, there = _places(words(data, bounds, ALNUM)[0], known)
                counts += np.bincount(at[there], minlength=len(known))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], names=["place", "n"]
        )

    rows = docs.select("text").mapInArrow(run, "place bigint, n bigint")
    table = rows.groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(terms), np.int64)
    counts[table.column("place").to_numpy()] = table.column("n").to_numpy()
    return counts


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and what tells rows apart: the id, never null, and a text hash."""
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.lit(-(2**63))).alias("doc"),
        F.xxhash64("text").alias("version"),
        "text",
    )


def build_index(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Words and postings of the given terms, one stored row per document."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    schema = "doc_id bigint, doc bigint, version bigint, n_words bigint, term array<bigint>, pos array<int>"

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, term, pos = [], [], []
            for found in _row_words(batch.column("text")):
                at, there = _places(found, shared.value)
                places = np.flatnonzero(there)
                sizes.append(len(found))
                term.append(found[places].astype(np.int64))
                pos.append(places.astype(np.int32))
            columns = [batch.column(name) for name in ("doc_id", "doc", "version")]
            columns += [
                pa.array(sizes, pa.int64()),
                pa.array(term, pa.list_(pa.int64())),
                pa.array(pos, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "doc", "version", "n_words", "term", "pos"]
            )

    return stored(keyed(docs).mapInArrow(run, schema), "index")


def postings(index: DataFrame) -> DataFrame:
    """The index by term: ``term, doc, version, pos``."""
    pair = F.explode(F.arrays_zip("term", "pos")).alias("p")
    return index.select("doc", "version", pair).select("doc", "version", "p.term", "p.pos")


def phrase_candidates(index: DataFrame, windows: Windows, counts: np.ndarray) -> DataFrame:
    """``doc, version, window, start`` where all the rarest terms stand right."""
    spark = index.sparkSession
    lists = postings(index)
    rows = [
        (number, rank, int(windows.terms[place].astype(np.int64)), offset)
        for number, ranked in enumerate(windows.anchors(counts))
        for rank, (offset, place) in enumerate(ranked)
    ]
    starts = spark.createDataFrame(rows, "window int, rank int, term bigint, offset int")
    first = starts.where("rank = 0").join(lists, "term")
    found = first.select("doc", "version", "window", (F.col("pos") - F.col("offset")).alias("start"))
    found = found.where("start >= 0")
    for rank in range(1, ANCHORS):
        nth = starts.where(F.col("rank") == rank).select("window", "term", "offset")
        asked = found.join(nth, "window", "left").withColumn(
            "pos", F.col("start") + F.col("offset")
        )
        # Windows of fewer distinct terms have nothing more to ask for.
        done = asked.where("term IS NULL").select(*found.columns)
        met = asked.where("term IS NOT NULL").join(
            lists, ["doc", "version", "term", "pos"], "left_semi"
        )
        found = met.select(*done.columns).unionByName(done)
    return found


def proximity_matches(docs: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """``query_id, doc_id, last_pos``: spans of at most ``within`` words with all query words.

    ``queries`` has ``query_id, text`` and at most WORDS_AT_ONCE words. A row
    for each position (from 0) of a query word whose span of the ``within``
    words up to it holds every distinct word of the query.
    """
    asked = queries.select("query_id", "text").toArrow()
    texts = asked.column("text").combine_chunks()
    rows, every = [], set()
    for query, found in zip(asked.column("query_id").to_pylist(), _row_words(texts), strict=True):
        distinct = np.unique(found).astype(np.int64).tolist()
        every.update(distinct)
        rows += [(query, term, len(distinct)) for term in distinct]
    terms = np.sort(np.array(sorted(every), np.int64).astype(_U))
    spark = docs.sparkSession
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, term bigint, n int"
    lists = postings(build_index(docs, terms)).join(spark.createDataFrame(rows, schema), "term")
    span = Window.partitionBy("query_id", "doc", "version").orderBy("pos")
    seen = F.size(F.collect_set("term").over(span.rangeBetween(-(within - 1), 0)))
    near = lists.withColumn("seen", seen).where("seen = n")
    doc_id = F.nullif(F.col("doc"), F.lit(-(2**63))).alias("doc_id")
    return near.select("query_id", doc_id, F.col("pos").alias("last_pos")).distinct()


def _spots(candidates: DataFrame) -> DataFrame:
    """The candidates of each document in one row, stored."""
    spots = candidates.groupBy("doc", "version").agg(
        F.collect_set(F.struct("window", "start")).alias("at")
    )
    return stored(spots, "candidates")


def _confirmed(spots: DataFrame, docs: DataFrame, windows: Windows) -> DataFrame:
    """Exact occurrences, as covered word positions and item names per document."""
    known = docs.sparkSession.sparkContext.broadcast((windows.words, windows.items))
    schema = "doc bigint, version bigint, covered array<int>, items array<string>"

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, names = known.value
        for batch in batches:
            at = batch.column("at").to_pylist()
            covered, items = [], []
            for spots, found in zip(at, _row_words(batch.column("text")), strict=True):
                hit, named = np.zeros(len(found), bool), set()
                for spot in spots:
                    text, start = texts[spot["window"]], spot["start"]
                    if np.array_equal(found[start : start + len(text)], text):
                        hit[start : start + len(text)] = True
                        named.update(names[spot["window"]])
                covered.append(np.flatnonzero(hit).astype(np.int32))
                items.append(sorted(named))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc"),
                    batch.column("version"),
                    pa.array(covered, pa.list_(pa.int32())),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=["doc", "version", "covered", "items"],
            )

    ids = spots.select(F.nullif(F.col("doc"), F.lit(-(2**63))).alias("doc_id"))
    texts = keyed(passing(docs, id_filter(ids.where("doc_id IS NOT NULL")))).drop("doc_id")
    nameless = keyed(docs.where("doc_id IS NULL")).drop("doc_id")
    rows = texts.unionByName(nameless).dropDuplicates(["doc", "version"])
    return rows.join(spots, ["doc", "version"]).select("doc", "version", "text", "at").mapInArrow(
        run, schema
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``doc_id, n_words, covered, items``: one row for each row of ``docs``.

    ``covered`` are the positions (from 0) of words inside any occurrence of a
    window of ``items`` (``item_id, text``), ``items`` the sorted names of the
    items with occurring windows. A window is ``window`` consecutive words; an
    item of fewer, but not none, is one window. A-Z count as a-z; words may be
    of any other script. Null and empty texts have no words; a null item_id is
    named "null". Rows that repeat a doc_id are told apart by their text. Other
    columns are ignored; empty tables give empty arrays or no rows.
    """
    words_of_items = F.sum(F.length("text") / 2 + 1)
    size = items.agg(words_of_items).first()[0] or 0
    parts = int(size // WORDS_AT_ONCE) + 1
    index, found = None, None
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        table = own.select("item_id", "text").toArrow()
        texts = table.column("text").cast(pa.string()).combine_chunks()
        windows = Windows(table.column("item_id").to_pylist(), texts, window)
        counts = term_counts(docs, windows.terms)
        places = sorted({place for ranked in windows.anchors(counts) for _, place in ranked})
        discard(index)
        index = build_index(docs, windows.terms[places])
        spots = _spots(phrase_candidates(index, windows, counts))
        hits = stored(_confirmed(spots, docs, windows).where("size(covered) > 0"), "hits")
        discard(spots)
        found = hits if found is None else found.unionByName(hits)
    per_doc = found
    if parts > 1:
        flat = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("covered", "items")]
        per_doc = per_doc.groupBy("doc", "version").agg(*flat)
    out = index.select("doc_id", "doc", "version", "n_words").join(
        per_doc, ["doc", "version"], "left"
    )
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("covered", F.expr("cast(array() as array<int>)")).alias("covered"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )
