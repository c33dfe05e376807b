"""Language-model scores of texts: corpus counts of words, and causal self-attention.

Texts are cut into words once, in chunks of some megabytes: a chunk keeps its
distinct words, and each document the places of its words among them. The chunks'
words are shuffled by word, counted over all learning documents, and go back to
their chunks, where every document is scored. What the
corpus says about single words and subword ids comes from all of it; so does the
network on top: fitted on some windows to begin with, it goes on in replicas, one for
each task, which read every learning document whole and whose weights are averaged.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from flowscore.llm.attention import Adam, Attention, Codes, score_streams, spectral_order
from flowscore.llm.scratch import bounded_batches, stored

# Bytes of text in a chunk, unless one text alone has more.
CHUNK_BYTES = 16 << 20
SMOOTHING = 0.1
# Distinct words that a stored row of a chunk holds.
WORDS_A_ROW = 4096
# Weight of the words' shares in the corpus beside the network.
COUNT_SHARE = 0.4
# Words of a window of the first fit, which sees at most so many, the least by a hash of DRAW_BITS.
WINDOW_WORDS, FIT_WINDOWS, FIT_STEPS, DRAW_BITS = 16, 20_000, 500, 56
# How often it sees each of them at most, and how many at a time.
FIT_EPOCHS, WINDOWS_A_STEP = 6, 64
# Step size of the replicas that read everything.
LEARN_RATE = 0.002
# Weights of a replica that travel in one row.
WEIGHTS_A_ROW = 1 << 14
# Words that are cut into subword ids at a time, and ids that are scored at a time.
WORDS_A_TIME, IDS_A_TIME = 1 << 15, 1 << 19

ENCODED = (
    "kind string, chunk bigint, doc_id bigint, held_out boolean, places array<int>, "
    "place int, n array<bigint>, words array<string>"
)
WINDOWS = "words array<string>, first boolean, last boolean, draw bigint"
_FIELDS = [
    ("kind", pa.string()),
    ("chunk", pa.int64()),
    ("doc_id", pa.int64()),
    ("held_out", pa.bool_()),
    ("places", pa.list_(pa.int32())),
    ("place", pa.int32()),
    ("n", pa.list_(pa.int64())),
    ("words", pa.list_(pa.string())),
]
_SCHEMA = pa.schema(_FIELDS)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Documents that nothing is learned from. A null id is never held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def text_words(column: pa.Array) -> pa.ListArray:
    """The words of each text, A-Z in lower case; null has none."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    flat, sizes = split.flatten(), pc.list_value_length(split).to_numpy()
    real = pc.not_equal(flat, "")
    kept = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    bounds = kept[np.append(0, np.cumsum(sizes))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), flat.filter(real))


def _runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of a chunk each."""
    ends = np.cumsum(pc.binary_length(column.fill_null("")).to_numpy().astype(np.int64))
    low = 0
    while low < len(column):
        before = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, before + CHUNK_BYTES, "right")), low + 1)
        yield low, high
        low = high


def _batch(kind: str, size: int, **columns: pa.Array) -> pa.RecordBatch:
    arrays = [columns.get(name, None) for name, _ in _FIELDS]
    arrays[0] = pa.array([kind] * size, pa.string())
    return pa.RecordBatch.from_arrays(
        [pa.nulls(size, t) if a is None else a for a, (_, t) in zip(arrays, _FIELDS, strict=True)],
        schema=_SCHEMA,
    )


def _windows(lists: pa.ListArray, draws: np.ndarray, share: float) -> pa.RecordBatch:
    """Runs of words that the first fit may see: a share of them, by a hash of text and place."""
    sizes = pc.list_value_length(lists).to_numpy()
    counts = -(-sizes // WINDOW_WORDS)
    row = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    mixed = (draws[row].astype(np.uint64) + nth.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    draw = (mixed >> np.uint64(64 - DRAW_BITS)).astype(np.int64)
    kept = np.flatnonzero(draw <= int(share * 2**DRAW_BITS))
    row, nth = row[kept], nth[kept]
    starts = lists.offsets.to_numpy()[:-1][row] + nth * WINDOW_WORDS
    widths = np.minimum(WINDOW_WORDS, sizes[row] - nth * WINDOW_WORDS)
    at = np.repeat(starts, widths) + np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths)
    bounds = np.append(0, np.cumsum(widths)).astype(np.int32)
    words = pa.ListArray.from_arrays(pa.array(bounds), lists.values.take(pa.array(at)))
    ends = [pa.array(nth == 0), pa.array((nth + 1) * WINDOW_WORDS >= sizes[row])]
    return pa.RecordBatch.from_arrays(
        [words, *ends, pa.array(draw[kept])], names=["words", "first", "last", "draw"]
    )


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, put together until they hold the text of a chunk."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encode(docs: DataFrame) -> DataFrame:
    """Documents as places in their chunk's words, and the words of each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunked(batches):
            for low, high in _runs(batch.column("text")):
                part = batch.slice(low, high - low)
                held = part.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
                # A chunk is named by its first row.
                chunk = pa.array([part.column("row")[0].as_py()] * part.num_rows, pa.int64())
                lists = text_words(part.column("text"))
                coded = pc.dictionary_encode(lists.flatten())
                places = pa.ListArray.from_arrays(lists.offsets, coded.indices)
                yield _batch(
                    "doc", part.num_rows, chunk=chunk, doc_id=part.column("doc_id"),
                    held_out=part.column("held_out"), places=places,
                )
                size = len(coded.dictionary)
                known = np.repeat(~held, pc.list_value_length(lists).to_numpy())
                counts = np.bincount(coded.indices.to_numpy()[known], minlength=size)
                starts = np.arange(0, size, WORDS_A_ROW, dtype=np.int32)
                bounds = pa.array(np.append(starts, size).astype(np.int32))
                yield _batch(
                    "words", len(starts), chunk=pa.array(np.full(len(starts), chunk[0].as_py())),
                    place=pa.array(starts),
                    words=pa.ListArray.from_arrays(bounds, coded.dictionary),
                    n=pa.ListArray.from_arrays(bounds, pa.array(counts.astype(np.int64))),
                )

    doc_id = F.col("doc_id").cast("bigint")
    rows = docs.select(
        doc_id.alias("doc_id"),
        "text",
        held_out(doc_id).alias("held_out"),
        F.monotonically_increasing_id().alias("row"),
    )
    return rows.mapInArrow(run, ENCODED)


class Subwords:
    """Subword ids of words, by a public vocabulary; ``end`` follows a text's last word."""

    def __init__(self, path: str, pattern: str) -> None:
        self.path, self.pattern = path, pattern
        self._encoding = None
        with open(path, "rb") as lines:
            self.end = max(int(line.split()[1]) for line in lines) + 1

    def __reduce__(self):
        # The ranks are read where they are used, from the file's bytes.
        with open(self.path, "rb") as file:
            return _subwords, (file.read(), self.pattern, self.end)

    def ids(self, word: str) -> list[int]:
        if self._encoding is None:
            with open(self.path, "rb") as file:
                self._encoding = _encoding(file.read(), self.pattern)
        return self._encoding.encode_ordinary(" " + word)

    def all_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words, one after the other, and how many each has."""
        found, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for low in range(0, len(words), WORDS_A_TIME):
            ids = [self.ids(word) for word in words.slice(low, WORDS_A_TIME).to_pylist()]
            sizes.append(np.array([len(i) for i in ids], np.int64))
            found.append(np.fromiter(chain.from_iterable(ids), np.int32, int(sizes[-1].sum())))
        return np.concatenate(found), np.concatenate(sizes)

    def window(self, words: list[str], first: bool, last: bool) -> list[int]:
        """The ids of some words of a text, with what stands before its first and after its last."""
        ids = [i for word in words for i in self.ids(word)]
        return ([self.end] if first else []) + ids + ([self.end] if last else [])


def _encoding(data: bytes, pattern: str) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _subwords(data: bytes, pattern: str, end: int) -> Subwords:
    out = Subwords.__new__(Subwords)
    out.path, out.pattern, out.end, out._encoding = None, pattern, end, _encoding(data, pattern)
    return out


def look_up(encoded: DataFrame) -> DataFrame:
    """The words of the chunks with ``c``, how often each is learned, and whether it is its first row.

    A word has a row for each chunk at most, and the window keeps them on disk if need be.
    """
    own = W.partitionBy("word").orderBy("chunk", "place")
    whole = own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = encoded.where("kind = 'words'").select(
        "chunk", F.col("place").alias("start"), F.posexplode(F.arrays_zip("words", "n"))
    )
    words = rows.select(
        "chunk",
        (F.col("start") + F.col("pos")).alias("place"),
        F.col("col.words").alias("word"),
        F.col("col.n").alias("n"),
    )
    return words.select(
        "chunk",
        "place",
        "word",
        F.sum("n").over(whole).alias("c"),
        (F.row_number().over(own) == 1).alias("first"),
    )


def _piece_counts(words: DataFrame, subwords: Subwords) -> np.ndarray:
    """How often each subword id is learned: a row for each id and task at most."""
    shared = words.sparkSession.sparkContext.broadcast(subwords)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shared.value.end, np.int64)
        for batch in batches:
            pieces, sizes = shared.value.all_ids(batch.column("word"))
            np.add.at(out, pieces, np.repeat(batch.column("c").to_numpy(), sizes))
        seen = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(out[seen])], names=["piece", "n"])

    rows = words.where("c > 0").select("word", "c").mapInArrow(run, "piece bigint, n bigint")
    table = rows.groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(subwords.end)
    out[table.column("piece").to_numpy()] = table.column("n").to_numpy()
    return out


def _spread(begins: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Places of the items of runs that begin somewhere, one run after the other."""
    return np.repeat(begins - (np.cumsum(widths) - widths), widths) + np.arange(widths.sum())


def refined(learned: DataFrame, model: Attention, subwords: Subwords) -> Attention:
    """``model`` after every text of ``learned``: the mean of replicas that went on from it.

    Each task is a replica and reads all its texts once, every subword id and end
    as a target. Weights are summed by their place, so that a task holds one model.
    """
    shared = learned.sparkSession.sparkContext.broadcast((model, subwords))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given, words = shared.value
        # A worker that runs several tasks gets the same object again.
        replica = given.copy()
        adam, seen = Adam(replica.weights), 0
        for batch in batches:
            lists = text_words(batch.column("text"))
            lengths = pc.list_value_length(lists).to_numpy()
            coded = pc.dictionary_encode(lists.flatten())
            pieces, widths = words.all_ids(coded.dictionary)
            begins, sizes = np.append(np.cumsum(widths) - widths, len(pieces)), np.append(widths, 1)
            ends = np.cumsum(lengths)
            tokens = np.insert(coded.indices.to_numpy(), ends, len(widths))
            ids = np.append(pieces, np.int32(words.end))[_spread(begins[tokens], sizes[tokens])]
            of_doc = np.add.reduceat(sizes[tokens], ends - lengths + np.arange(len(lengths)))
            replica.learn(adam, ids, of_doc, words.end, LEARN_RATE)
            seen += len(ids)
        if seen:
            for name, w in replica.weights.items():
                flat = w.ravel()
                rows = [flat[i : i + WEIGHTS_A_ROW].tobytes() for i in range(0, len(flat), WEIGHTS_A_ROW)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(rows)),
                        pa.array(np.arange(len(rows), dtype=np.int32)),
                        pa.array(rows, pa.binary()),
                        pa.array(np.full(len(rows), seen)),
                    ],
                    names=["name", "part", "data", "seen"],
                )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for name, part, data, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total, n = sums.get((name, part), (0.0, 0))
                sums[name, part] = total + np.frombuffer(data, np.float32) * np.float64(seen), n + seen
        for (name, part), (total, n) in sums.items():
            columns = [[name], pa.array([part], pa.int32()), [(total / n).astype(np.float32).tobytes()], [n]]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                names=["name", "part", "data", "seen"],
            )

    schema = "name string, part int, data binary, seen bigint"
    parts = learned.select("text").mapInArrow(run, schema)
    # Sorted, so that sums are the same however the rows arrive.
    parts = parts.repartition("name", "part").sortWithinPartitions("name", "part", "seen", "data")
    table = parts.mapInArrow(summed, schema).toArrow().sort_by([("name", "ascending"), ("part", "ascending")])
    for name, w in model.weights.items():
        data = table.filter(pc.equal(table.column("name"), name)).column("data").to_pylist()
        if data:
            model.weights[name] = np.frombuffer(b"".join(data), np.float32).reshape(w.shape).copy()
    return model


def fit_network(learned: DataFrame, corpus: Corpus, counts: np.ndarray, subwords: Subwords) -> Attention:
    """The attention model: begun on FIT_WINDOWS windows at most, then over all of ``doc_id, text``."""
    most = corpus.tokens / WINDOW_WORDS + corpus.texts
    share = min(1.0, FIT_WINDOWS / max(1.0, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _windows(text_words(batch.column("text")), batch.column("draw").to_numpy(), share)

    fields = ("words", "first", "last")
    drawn = learned.select("text", F.xxhash64("text", "doc_id").alias("draw")).mapInArrow(run, WINDOWS)
    sample = drawn.orderBy("draw", "words").limit(FIT_WINDOWS).select(*fields).toArrow().to_pylist()
    ids = [subwords.window(*(row[name] for name in fields)) for row in sample]
    codes = Codes(spectral_order(ids, len(counts)), counts)
    model = Attention(codes, len(counts))
    model.fit(ids, min(FIT_STEPS, -(-FIT_EPOCHS * len(ids) // WINDOWS_A_STEP)), WINDOWS_A_STEP)
    return refined(learned, model, subwords)


@dataclass
class Corpus:
    """Numbers of the learning documents: tokens, distinct tokens, texts (and so ends)."""

    tokens: int
    distinct: int
    texts: int

    def log10_share(self, counts: np.ndarray) -> np.ndarray:
        below = self.tokens + SMOOTHING * (self.distinct + 1)
        return np.log10((counts + SMOOTHING) / below)

    def mixed(self, counts: np.ndarray, network: np.ndarray) -> np.ndarray:
        """Log10 of the weighted mean of a word's share in the corpus and what the network gives it.

        Both are distributions over words, so their mixture is one.
        """
        if not self.tokens:
            return network
        with np.errstate(divide="ignore"):
            share = np.log(COUNT_SHARE * counts / self.tokens)
        known = np.log(1 - COUNT_SHARE) + network * np.log(10)
        return np.logaddexp(share, known) / np.log(10)


OUT = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
    "base_score double, score double, network_score double"
)


def _scored(
    encoded: DataFrame, looked_up: DataFrame, corpus: Corpus, model: Attention, subwords: Subwords
) -> DataFrame:
    """Every document's scores, chunk by chunk."""
    shared = encoded.sparkSession.sparkContext.broadcast((corpus, model.ready(), subwords))

    def run(docs: pa.Table, lexicon: pa.Table) -> pa.Table:
        told, network, words = shared.value
        end = words.end
        order = np.argsort(lexicon.column("place").to_numpy())
        pieces, widths = words.all_ids(lexicon.column("word"))
        counts = np.append(lexicon.column("c").to_numpy()[order], told.texts)
        sizes = np.append(widths[order], 1)
        begins = np.append((np.cumsum(widths) - widths)[order], len(pieces))
        flat = np.append(pieces, np.int32(end))

        places = docs.column("places").combine_chunks()
        lengths = pc.list_value_length(places).to_numpy()
        values, ends = places.flatten().to_numpy(), np.cumsum(lengths)
        smoothed, totals = told.log10_share(counts), np.append(0, np.cumsum(lengths.astype(np.int64) + 1))
        base, known = np.zeros(len(lengths)), np.zeros(len(lengths), np.int64)
        score, network_score, low = np.zeros(len(lengths)), np.zeros(len(lengths)), 0
        while low < len(lengths):  # some documents at a time
            high = max(int(np.searchsorted(totals, totals[low] + IDS_A_TIME // 2, "right")) - 1, low + 1)
            begin = ends[low] - lengths[low]
            own = np.insert(values[begin : ends[high - 1]], ends[low:high] - begin, len(order))
            first = totals[low:high] - totals[low]
            base[low:high] = np.add.reduceat(smoothed[own], first)
            known[low:high] = np.add.reduceat((counts[own] > 0).astype(np.int64), first)
            width = sizes[own]
            of_doc = np.add.reduceat(width, first)
            by_id = score_streams(network, flat[_spread(begins[own], width)], of_doc, end)
            by_word = np.add.reduceat(by_id, np.cumsum(width) - width)
            network_score[low:high] = np.add.reduceat(by_word, first)
            score[low:high] = np.add.reduceat(told.mixed(counts[own], by_word), first)
            low = high
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "held_out": docs.column("held_out"),
                "n_tokens": pa.array(lengths.astype(np.int64) + 1),
                "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(len(lengths), told.tokens, np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(score),
                "network_score": pa.array(network_score),
            }
        )

    docs = encoded.where("kind = 'doc'").select("chunk", "doc_id", "held_out", "places")
    return docs.groupBy("chunk").cogroup(looked_up.groupBy("chunk")).applyInArrow(run, OUT)


def lm_scores(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The columns of ``OUT`` for every row.

    Tokens are words between ASCII white space, A-Z in lower case, and one end;
    null text is empty and has the end only. Learned from are the rows that are
    not ``held_out``, all of them for the counts. ``base_score`` adds up the
    words' smoothed log10 shares; ``network_score`` is the network's log10
    probability of the subword ids of all words and the end; ``score`` is that of
    the whole model, which gives each word a weighted mean of what the network gives its
    ids and of its share in the corpus. ``path`` and ``pattern`` name a vocabulary
    of byte-level BPE ranks. Repeated rows and null ids are rows like
    others; extra columns are not read; no rows give none. Where nothing is
    learned the counts are 0 and the network is as it was drawn. Runs jobs when called.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    subwords = Subwords(path, pattern)
    encoded = stored(encode(docs), "lm-encoded")
    looked_up = stored(look_up(encoded), "lm-words")
    words = looked_up.where("first")
    tokens, distinct = words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    texts = encoded.where("kind = 'doc' AND NOT held_out").count()
    corpus = Corpus((tokens or 0) + texts, distinct + (texts > 0), texts)
    pieces = np.append(_piece_counts(words, subwords), texts)
    learned = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(~held_out())
    model = fit_network(learned, corpus, pieces, subwords)
    lexicon = looked_up.select("chunk", "place", "word", "c")
    return _scored(encoded, lexicon, corpus, model, subwords)
