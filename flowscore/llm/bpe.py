"""Byte-level BPE with given ranks: encoding by a fold over distinct words, decoding.

Texts are split by a pattern, the distinct words of a task are merged by
higher-order functions against a literal map of ranked pairs (their first few
merges in arrays, for all words of a chunk at once), and the words of each
document are replaced by their ids. Documents travel in chunks of about a
megabyte of text; a word is merged in the first chunk that holds it and kept for
those that follow. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import copy
import heapq
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscore.llm.hashing import span_hashes
from flowscore.llm.scratch import bounded_batches, returning

_BUCKETS = 1 << 16
_SPREAD = 40503
# A piece of a word is one integer: from the top the id that it and its right
# neighbour merge into (or _NONE), its place in the word, its own id.
_ID_BITS, _RANK_AT = 24, 40
_ID, _NONE = (1 << _ID_BITS) - 1, (1 << 23) - 1
# Words longer than this are merged with a heap: the fold takes quadratic time.
FOLD_BYTES = 512
# Merges of each word that are made for all words of a chunk at once, before the fold.
FIRST_MERGES = 4
# Text of a chunk, one row of the fold; more only if one text alone is longer.
CHUNK_BYTES = 1 << 20
# Bytes of merged words that a task keeps. Beyond it, it begins anew: a word that
# comes again is merged again.
KEPT_BYTES = 1 << 23


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: a base64 token and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def ranked_pairs(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The id that two neighbouring ids merge into, for all that do."""
    pairs = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                pairs[left, right] = rank
    return pairs


def rank_map(pairs: dict[tuple[int, int], int]) -> Column:
    """The pairs as a literal: buckets of keys and ranks, so that a look-up is short.

    Ranks are at their place in a piece; the first of a bucket is for missing keys.
    """
    buckets: list[dict] = [{"k": [], "v": [_NONE << _RANK_AT]} for _ in range(_BUCKETS)]
    for (left, right), rank in pairs.items():
        bucket = buckets[(left * _SPREAD + right) % _BUCKETS]
        bucket["k"].append(left << _ID_BITS | right)
        bucket["v"].append(rank << _RANK_AT)
    text = json.dumps(buckets, separators=(",", ":"))
    return F.from_json(F.lit(text), "array<struct<k:array<bigint>,v:array<bigint>>>")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _rank(ranked: Column, left: Column, right: Column) -> Column:
    """What two neighbouring ids merge into, at its place in a piece."""
    key = left * (_ID + 1) + right

    def look(bucket: Column) -> Column:
        return F.get(bucket["v"], F.array_position(bucket["k"], key).cast("int"))

    place = (left * _SPREAD + right).bitwiseAND(F.lit(_BUCKETS - 1))
    return _let(F.get(ranked, place.cast("int")), look)


def merge_word(pieces: Column, ranked: Column) -> Column:
    """Fold the ranked merges over the pieces of one word, at first its bytes.

    Every step joins the leftmost pair of the smallest rank: the least integer.
    """
    low, place = F.lit((1 << _RANK_AT) - 1), F.lit(((1 << _RANK_AT) - 1) ^ _ID)

    def join(p: Column, best: Column, at: Column) -> Column:
        merged = F.shiftright(best, _RANK_AT)
        after = F.get(p, at + 1).bitwiseAND(F.lit(_ID))
        rank = F.coalesce(_rank(ranked, merged, after), F.lit(_NONE << _RANK_AT))
        joined = best.bitwiseAND(place) + merged + rank
        tail = F.slice(p, at + 2, F.size(p))

        def with_left(left: Column) -> Column:
            ranked_left = left.bitwiseAND(low) + _rank(ranked, left.bitwiseAND(F.lit(_ID)), merged)
            return F.concat(F.slice(p, F.lit(1), at - 2), F.array(ranked_left, joined), tail)

        return F.when(at == 1, F.concat(F.array(joined), tail)).otherwise(
            _let(F.get(p, at - 2), with_left)
        )

    def step(p: Column, _: Column) -> Column:
        return _let(
            F.array_min(p),
            lambda best: F.when(best >= _NONE << _RANK_AT, p).otherwise(
                _let(F.array_position(p, best).cast("int"), lambda at: join(p, best, at))
            ),
        )

    folded = F.aggregate(F.sequence(F.lit(2), F.size(pieces)), pieces, step)
    return F.when(F.size(pieces) < 2, pieces).otherwise(folded)


def merge_long_word(ids: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """The same merges with a heap and links, for words of any length."""
    n = len(ids)
    after = [*range(1, n), -1]
    before = [*range(-1, n - 1)]
    ids = list(ids)
    heap = [(pairs[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in pairs]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i] if ids[i] >= 0 else -1
        if j < 0 or pairs.get((ids[i], ids[j])) != rank:
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[i] >= 0:
            before[after[i]] = i
            if (ids[i], ids[after[i]]) in pairs:
                heapq.heappush(heap, (pairs[ids[i], ids[after[i]]], i))
        if before[i] >= 0 and (ids[before[i]], ids[i]) in pairs:
            heapq.heappush(heap, (pairs[ids[before[i]], ids[i]], before[i]))
    return [i for i in ids if i >= 0]


def _spread(begins: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Places of the items of runs that begin somewhere, one run after the other."""
    return np.repeat(begins - (np.cumsum(widths) - widths), widths) + np.arange(widths.sum())


class _Numbers:
    """The numbers of words, in the order in which they came.

    Held in arrays: about 20 bytes and its own for each word, where a dict takes over 100.
    A hash finds a word and its bytes confirm it; words whose hash an earlier one
    has are in ``others``. An empty word among the first is a gap, found by no one.
    """

    def __init__(self, words: list[bytes]) -> None:
        self.data, self.bounds = np.zeros(0, np.uint8), np.zeros(1, np.int32)
        self.hashes, self.places, self.others = np.zeros(0, np.uint64), np.zeros(0, np.int32), {}
        data, bounds, hashes = self._laid_out(words)
        self._add(words, data, bounds, hashes, np.flatnonzero(np.diff(bounds)))

    def copy(self) -> _Numbers:
        """The same numbers, to go on from: arrays are replaced, never changed."""
        out = copy.copy(self)
        out.others = dict(self.others)
        return out

    @staticmethod
    def _laid_out(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bounds = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)), out=bounds[1:])
        data = np.frombuffer(b"".join(words), np.uint8)
        return data, bounds, span_hashes(data, bounds[:-1], bounds[1:])

    def _add(self, words: list[bytes], data: np.ndarray, bounds: np.ndarray, hashes: np.ndarray, found: np.ndarray) -> None:
        """Number all of ``words`` on; the places in ``found`` can be found from now on."""
        numbers = len(self.bounds) - 1 + np.arange(len(words), dtype=np.int32)
        keys, one = np.unique(hashes[found], return_index=True)
        at = np.searchsorted(self.hashes, keys)
        is_new = np.ones(len(keys), bool)
        inside = at < len(self.hashes)
        is_new[inside] = self.hashes[at[inside]] != keys[inside]
        first = found[one[is_new]]
        for i in np.setdiff1d(found, first).tolist():
            self.others[words[i]] = int(numbers[i])
        self.hashes = np.insert(self.hashes, at[is_new], keys[is_new])
        self.places = np.insert(self.places, at[is_new], numbers[first])
        self.bounds = np.concatenate([self.bounds, (self.bounds[-1] + bounds[1:]).astype(np.int32)])
        self.data = np.concatenate([self.data, data])

    def numbered(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """The number of each of some distinct words, and those seen for the first time."""
        data, bounds, hashes = self._laid_out(words)
        at = np.searchsorted(self.hashes, hashes)
        met = np.flatnonzero(at < len(self.hashes))
        met = met[self.hashes[at[met]] == hashes[met]]
        number = self.places[at[met]]
        width, begin = np.diff(bounds)[met], self.bounds[number].astype(np.int64)
        same = self.bounds[number + 1] - begin == width
        size = width[same]
        differ = data[_spread(bounds[met[same]], size)] != self.data[_spread(begin[same], size)]
        total, ends = np.append(0, np.cumsum(differ)), np.cumsum(size)
        same[same] = total[ends] == total[ends - size]
        out = np.full(len(words), -1, np.int32)
        out[met[same]] = number[same]
        for i in met[~same].tolist():
            out[i] = self.others.get(words[i], -1)
        new = np.flatnonzero(out < 0)
        out[new] = len(self.bounds) - 1 + np.arange(len(new))
        size = np.diff(bounds)[new]
        added = [words[i] for i in new.tolist()]
        self._add(
            added, data[_spread(bounds[new], size)], np.append(0, np.cumsum(size)), hashes[new], np.arange(len(new))
        )
        return out, added


def token_arrays(ranks: dict[bytes, int], pairs: dict[tuple[int, int], int]) -> dict:
    """The ranks as arrays, for the look-ups of ``_Tokens``."""
    keys = np.array([left << _ID_BITS | right for left, right in pairs], np.int64)
    order = np.argsort(keys)
    return {
        "byte_ids": np.array([ranks[bytes([b])] for b in range(256)], np.int64),
        "tokens": _Numbers(_tokens_by_id(ranks)),
        "keys": keys[order],
        "merged": np.array(list(pairs.values()), np.int64)[order],
    }


def _id_count(ranks: dict[bytes, int]) -> int:
    return max(ranks.values(), default=-1) + 1


class _Tokens:
    """Numbers the words of a task and turns new ones into what the fold begins with.

    A word that is a token has its id for a number; the others follow the ids in
    order of appearance, until more than ``KEPT_BYTES`` of them are known.
    """

    def __init__(self, arrays: dict) -> None:
        self.__dict__.update(arrays)
        self.forget()

    @cached_property
    def pairs(self) -> dict[tuple[int, int], int]:
        """As a dict, which only words too long for the fold need."""
        left, right = (self.keys >> _ID_BITS).tolist(), (self.keys & _ID).tolist()
        return dict(zip(zip(left, right, strict=True), self.merged.tolist(), strict=True))

    def forget(self) -> None:
        self.numbers = self.tokens.copy()
        self.kept = self.kept_bytes = 0

    def numbered(self, distinct: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """The number of each word, and those seen for the first time."""
        out, new = self.numbers.numbered(distinct)
        self.kept += len(new)
        self.kept_bytes += sum(map(len, new))
        return out, new

    def pieces(self, words: list[bytes]) -> pa.Array:
        """The pieces of each word: its bytes, or what needs no more merging."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        widths = np.array([len(word) for word in words], np.int64)
        ends = np.cumsum(widths)
        ids = self.byte_ids[raw]
        word = np.repeat(np.arange(len(widths)), widths)
        ranks = self._merges(ids, word, np.arange(len(ids)))
        keep = np.ones(len(ids), bool)
        for w in np.flatnonzero(widths > FOLD_BYTES):
            first, end = ends[w] - widths[w], ends[w]
            merged = merge_long_word(ids[first:end].tolist(), self.pairs)
            ids[first : first + len(merged)] = merged
            ranks[first:end] = _NONE
            keep[first + len(merged) : end] = False
        place = np.minimum(np.arange(len(raw)) - np.repeat(ends - widths, widths), 65535)
        ids, ranks, word, place = (x[keep] for x in (ids, ranks, word, place))
        for _ in range(FIRST_MERGES):
            ids, ranks, word, place = self._joined(ids, ranks, word, place)
        sizes = np.bincount(word, minlength=len(widths))
        values = ranks << _RANK_AT | place << _ID_BITS | ids
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values))

    def _merges(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What the pieces ``at`` some places and their right neighbours merge into, or _NONE."""
        out = np.full(len(at), _NONE, np.int64)
        if len(ids) > 1 and len(self.keys):
            right = np.minimum(at + 1, len(ids) - 1)
            asked = ids[at] << _ID_BITS | ids[right]
            found = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
            met = (self.keys[found] == asked) & (word[right] == word[at]) & (right > at)
            out[met] = self.merged[found[met]]
        return out

    def _joined(
        self, ids: np.ndarray, ranks: np.ndarray, word: np.ndarray, place: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The step of the fold, in all words: the leftmost pair of the smallest rank is joined."""
        first = np.flatnonzero(np.diff(word, prepend=-1))
        if not len(first):
            return ids, ranks, word, place
        order = ranks << 16 | place
        best = np.minimum.reduceat(order, first)
        best = np.repeat(best, np.diff(first, append=len(word)))
        at = np.flatnonzero((order == best) & (ranks != _NONE))
        ids[at] = ranks[at]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        ids, ranks, word, place = (x[keep] for x in (ids, ranks, word, place))
        at -= np.arange(len(at))
        again = np.concatenate([at, at[at > 0] - 1])
        # A word too long for the fold has no pairs left, so none of its neighbours is asked for.
        ranks[again] = self._merges(ids, word, again)
        return ids, ranks, word, place


def _cuts(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most ``limit`` bytes, one row at least."""
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        before = ends[low - 1] if low else 0
        high = max(int(np.searchsorted(ends, before + limit, "right")), low + 1)
        yield low, high
        low = high


def _chunks(words: DataFrame, arrays: dict) -> DataFrame:
    """A row for each chunk of documents: the numbers of their words, the pieces of new ones.

    ``base`` words of the task were numbered before; 0 begins a new numbering.
    """
    shared = words.sparkSession.sparkContext.broadcast(arrays)
    schema = (
        "doc_ids array<bigint>, sizes array<int>, places array<int>, base int, "
        "pieces array<array<bigint>>"
    )

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(shared.value)
        for batch in batches:
            lists = batch.column("words")
            counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            widths = pc.binary_length(lists.flatten()).to_numpy(zero_copy_only=False)
            total = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
            edges = np.concatenate([[0], np.cumsum(counts)])
            for low, high in _cuts(np.diff(total[edges]), CHUNK_BYTES):
                if tokens.kept_bytes > KEPT_BYTES:
                    tokens.forget()
                coded = pc.dictionary_encode(lists.slice(low, high - low).flatten())
                base = tokens.kept
                numbers, new = tokens.numbered(coded.dictionary.cast(pa.binary()).to_pylist())
                columns = [
                    batch.column("doc_id").slice(low, high - low),
                    pa.array(counts[low:high].astype(np.int32)),
                    pa.array(numbers[coded.indices.to_numpy(zero_copy_only=False)]),
                    tokens.pieces(new),
                ]
                columns = [pa.ListArray.from_arrays([0, len(c)], c) for c in columns]
                columns.insert(3, pa.array([base], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_ids", "sizes", "places", "base", "pieces"]
                )

    return words.mapInArrow(run, schema)


class _Decoder:
    """Adds ``packed`` and ``decoded`` to batches of ``doc_id, ids``."""

    def __init__(self, by_id: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(by_id), np.uint8)
        self.lengths = np.array([len(token) for token in by_id], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        packed, decoded = [], []
        for ids in batch.column("ids"):
            if not ids.is_valid:
                packed.append(None)
                decoded.append(None)
                continue
            values = ids.values.to_numpy(zero_copy_only=False)
            packed.append(values.astype("<u4").tobytes())
            sizes = self.lengths[values]
            at = np.repeat(self.begins[values] - (np.cumsum(sizes) - sizes), sizes)
            decoded.append(self.data[at + np.arange(len(at))].tobytes())
        columns = [batch.column("doc_id"), batch.column("ids")]
        columns += [pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "packed", "decoded"])


def _tokens_by_id(ranks: dict[bytes, int]) -> list[bytes]:
    by_id = [b""] * _id_count(ranks)
    for token, rank in ranks.items():
        by_id[rank] = token
    return by_id


IDS_SCHEMA = "doc_id bigint, ids array<int>"
DECODED_SCHEMA = f"{IDS_SCHEMA}, packed binary, decoded binary"


class _Merged:
    """The ids of the numbered words of a task: a token's own, or those of a merged word."""

    def __init__(self, id_count: int) -> None:
        self.id_count = id_count
        self.forget()

    def forget(self) -> None:
        self.flat = np.arange(self.id_count, dtype=np.int32)
        self.bounds = np.arange(self.id_count + 1, dtype=np.int64)

    def documents(self, chunk: pa.RecordBatch, row: int) -> pa.RecordBatch:
        """The ids of the documents of one chunk; its merged words are kept."""
        doc_ids, sizes, places = (chunk.column(c).slice(row, 1).flatten() for c in range(3))
        pieces = chunk.column(4).slice(row, 1).flatten()
        if chunk.column(3)[row].as_py() == 0:
            self.forget()
        merged = pieces.flatten().to_numpy(zero_copy_only=False).astype(np.int64) & _ID
        lengths = pc.list_value_length(pieces).to_numpy(zero_copy_only=False)
        self.flat = np.concatenate([self.flat, merged.astype(np.int32)])
        new_bounds = self.bounds[-1] + np.cumsum(lengths, dtype=np.int64)
        self.bounds = np.concatenate([self.bounds, new_bounds])
        at = places.to_numpy(zero_copy_only=False)
        size_of = self.bounds[at + 1] - self.bounds[at]
        ends = np.cumsum(size_of)
        first = np.repeat(self.bounds[at] - (ends - size_of), size_of)
        ids = self.flat[first + np.arange(len(first))]
        edges = np.concatenate([[0], np.cumsum(sizes.to_numpy(zero_copy_only=False))])
        bounds = np.concatenate([[0], ends])[edges].astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))
        return pa.RecordBatch.from_arrays([doc_ids, lists], names=["doc_id", "ids"])


def _reassembled(chunks: DataFrame, ranks: dict[bytes, int], decoded: bool) -> DataFrame:
    """Each document's ids, from the merged words of its task, and what they decode to."""
    shared = chunks.sparkSession.sparkContext.broadcast(_tokens_by_id(ranks))

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _Decoder(shared.value)
        merged = _Merged(len(shared.value))
        for batch in batches:
            for row in range(batch.num_rows):
                found = merged.documents(batch, row)
                yield decoder(found) if decoded else found

    return chunks.mapInArrow(run, DECODED_SCHEMA if decoded else IDS_SCHEMA)


def _merged_chunks(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """The chunks of ``docs``, their distinct words merged by the fold."""
    bounded_batches(docs.sparkSession)
    pairs = ranked_pairs(ranks)
    # (?U): white space is Unicode's, as the pattern means it.
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))
    words_of = docs.select(F.col("doc_id").cast("bigint"), words.alias("words"))
    chunks = _chunks(words_of, token_arrays(ranks, pairs))
    table = F.array(rank_map(pairs))
    merged = F.transform(table, lambda m: F.transform("pieces", lambda p: merge_word(p, m)))
    merged = F.get(merged, F.lit(0)).alias("pieces")
    return chunks.select("doc_ids", "sizes", "places", "base", merged)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, ids``: the tokens of each row's whole text, one row for each.

    Every match of ``pattern`` is encoded by itself, as one token if it is one,
    else by merging the neighbours of the smallest rank until none is left; no
    special tokens. Null and empty texts have no tokens. Repeated rows and null
    doc_ids are kept as they are; other columns are ignored; no rows give none. A
    text longer than a chunk is a chunk of its own.
    """
    return _reassembled(_merged_chunks(docs, ranks, pattern), ranks, decoded=False)


def encode_and_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``decode(encode(docs))``, the ids decoded by the worker that puts them together."""
    return _reassembled(_merged_chunks(docs, ranks, pattern), ranks, decoded=True)


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``encoded`` with ``packed``, the ids as little-endian 32-bit integers, and ``decoded``.

    Decoding concatenates the bytes of the tokens; they need not be valid UTF-8.
    Null ids give null.
    """
    bounded_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(_tokens_by_id(ranks))

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _Decoder(shared.value)
        for batch in batches:
            yield decoder(batch)

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED_SCHEMA)
