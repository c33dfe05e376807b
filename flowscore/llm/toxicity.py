"""Toxicity by two class-conditional Kneser-Ney bigram models.

A toxic and an ordinary model share their last backoff, the continuation
counts of words over both classes, so that an expression seen in neither class
says little. A document's ratio is the difference of the two log-likelihoods
per word. It is one feature; the other adds up what those expressions say whose
class counts differ beyond chance. A logistic curve over both, fitted on
labelled documents that were not counted, turns them into a score.

Words and bigrams are counted exactly by Spark and keyed by 64-bit hashes. Each
counted word, context and bigram is an entry of a stored table that grows with
the input. Scoring looks texts up in it by a join; of fixed size are only a
filter over words and contexts and the commonest entries, which are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscore.llm.hashing import ALNUM, FILTER_BITS, folded, id_filter, passing, text_chunks, words
from flowscore.llm.scratch import discard, returning, stored

DISCOUNT = 0.75
# Standard deviations that class counts must differ by to count for the second feature.
SIGMAS = 4.0
# Documents that the logistic curve is fitted on, at most.
CURVE_DOCS = 20_000
# Keys with at least this part of all rows are joined by broadcast: never more keys than that.
HOT = 1 << 16
# Entries with at least this part of all words (contexts, bigrams) are sent to the workers, 24
# bytes each: never more of a kind than that, whatever the input.
COMMON = 1 << 20
_U = np.uint64


@dataclass
class Model:
    """``key, value, clear`` of every entry, and what is sent to the workers.

    ``keys`` (sorted) and ``values`` (two rows: value, clear) are the commonest
    entries, ``bits`` a filter over the keys of the other words and contexts.
    The value of a word is its log-ratio above that of a word never seen, which
    is ``unseen``; that of a context the log-ratio of its backoff weights; that
    of a bigram what its log-ratio has above those of its context and word.
    ``clear`` is the log-ratio of words and bigrams whose class counts differ
    beyond chance (for a bigram above that of its word), else 0.
    """

    entries: DataFrame
    keys: np.ndarray
    values: np.ndarray
    bits: np.ndarray
    unseen: float


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose labels are never used. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _bigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word before, word, row) of every word; the first of a text follows word 0."""
    word, _, rows = words(data, bounds, ALNUM)
    before = np.concatenate([np.zeros(1, _U), word[:-1]]) if len(word) else word
    before[np.flatnonzero(np.diff(rows, prepend=-1))] = 0
    return before, word, rows


def _keys(before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the entries of words, of contexts and of bigrams."""
    found = [word], [before, before, before], [before, word]
    return tuple(folded(parts).view(np.int64) for parts in found)


def count_bigrams(rows: DataFrame) -> DataFrame:
    """``before, word, n0, n1`` of ``text, toxic`` rows: counts in each class, stored."""

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            for first, data, bounds in text_chunks(batch.column("text")):
                before, word, row = _bigrams(data, bounds)
                _, one_of, at = np.unique(_keys(before, word)[2], return_index=True, return_inverse=True)
                one = toxic[first + row].astype(np.float64)
                n1 = np.bincount(at, one, len(one_of)).astype(np.int64)
                n = np.bincount(at, minlength=len(one_of))
                pair = [pa.array(x[one_of].view(np.int64)) for x in (before, word)]
                yield pa.RecordBatch.from_arrays(
                    [*pair, pa.array(n - n1), pa.array(n1)], names=["before", "word", "n0", "n1"]
                )

    found = rows.select("toxic", "text").mapInArrow(run, "before bigint, word bigint, n0 bigint, n1 bigint")
    counts = found.groupBy("before", "word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    return stored(counts, "bigrams")


def _joined(rows: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has every ``key``; its heavy keys by broadcast."""
    least = (table.agg(F.sum(weight)).head()[0] or 0) / HOT
    heavy = F.broadcast(table.where(F.col(weight) >= least).drop(weight))
    light = table.where(F.col(weight) < least).drop(weight)
    rest = rows.join(heavy.select(key), key, "left_anti").join(light.hint("merge"), key)
    return rows.join(heavy, key).unionByName(rest)


def _rare(share: Column) -> Column:
    """Do the counts of the classes not differ beyond chance from the shared count?"""
    expected = (F.col("n0") + F.col("n1")) * share
    return F.abs(F.col("n1") - expected) <= SIGMAS * F.sqrt(expected * (1 - share) + 1)


def build_model(counts: DataFrame) -> Model:
    """The entries: every word, context and bigram that was counted.

    A class gives a word after a context its discounted count there over that of
    the context, plus the mass set free times the lower order; a context that the
    class lacks frees all. The lower order is made alike of the word's continuation
    counts in the class, and backs off to those over both classes. The first word
    of a text stands after none and has the lower order.
    """
    held = [F.sum((F.col(f"n{c}") > 0).cast("bigint")) for c in "01"]
    sums = [F.sum(f"n{c}") for c in "01"]
    named = [x.alias(f"{name}{c}") for name, xs in (("n", sums), ("after", held)) for c, x in zip("01", xs, strict=True)]
    all_words = stored(counts.groupBy("word").agg(F.count("*").alias("pairs"), *named), "words")
    known = [F.sum((F.col(f"after{c}") > 0).cast("bigint")) for c in "01"]
    totals = [F.sum(f"{name}{c}") for name in ("n", "after") for c in "01"]
    found = all_words.agg(F.count("*"), F.sum("pairs"), *totals, *known).head()
    n_words, n_pairs, n0, n1, *per_class = [x or 0 for x in found]
    # One word more than were counted: the unseen.
    shared = (F.col("pairs") + 0.5) / F.lit(n_pairs + 0.5 * (n_words + 1))
    lower, free = {}, {}
    for c, after, types in zip("01", per_class[:2], per_class[2:], strict=True):
        free[c] = DISCOUNT * types / after if after else 1.0
        kept = F.greatest(F.col(f"after{c}") - DISCOUNT, F.lit(0.0)) / F.lit(float(max(1, after)))
        lower[c] = kept + F.lit(free[c]) * shared
    unseen = float(np.log(free["1"]) - np.log(free["0"]))
    share = F.lit(max(1, n1) / (max(1, n0) + max(1, n1)))
    ratio = F.log(lower["1"]) - F.log(lower["0"])
    by_word = all_words.select(
        "word",
        "pairs",
        (F.col("n0") + F.col("n1")).alias("n"),
        *[lower[c].alias(f"lower{c}") for c in "01"],
        ratio.alias("word_ratio"),
        F.when(~_rare(share), ratio).otherwise(0.0).alias("word_clear"),
    )
    counts = counts.where("before <> 0")
    by_context = counts.groupBy("before").agg(
        *[x.alias(f"seen{c}") for c, x in zip("01", sums, strict=True)],
        *[x.alias(f"types{c}") for c, x in zip("01", held, strict=True)],
        F.count("*").alias("pairs"),
    )
    weight = [F.coalesce(DISCOUNT * F.col(f"types{c}") / F.nullif(F.col(f"seen{c}"), F.lit(0)), F.lit(1.0)) for c in "01"]
    by_context = stored(
        by_context.select("*", *[w.alias(f"free{c}") for c, w in zip("01", weight, strict=True)]), "contexts"
    )
    context_ratio = F.log("free1") - F.log("free0")
    pairs = _joined(counts, by_context.drop("types0", "types1"), "before", "pairs")
    pairs = _joined(pairs, by_word.drop("n"), "word", "pairs")
    log = {}
    for c in "01":
        kept = F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.greatest(f"seen{c}", F.lit(1))
        log[c] = F.log(kept + F.col(f"free{c}") * F.col(f"lower{c}"))
    clear = ~_rare(F.col("seen1") / (F.col("seen0") + F.col("seen1")))
    ratio, null = log["1"] - log["0"], F.lit(None).cast("bigint")
    own = pairs.select(
        "before",
        "word",
        (ratio - context_ratio - F.col("word_ratio")).alias("value"),
        F.when(clear, ratio - F.col("word_clear")).otherwise(0.0).alias("clear"),
        (F.col("n0") + F.col("n1")).alias("n"),
    )
    plain = by_word.select(
        null.alias("before"), "word", F.col("word_ratio") - F.lit(unseen), "word_clear", "n"
    )
    contexts = by_context.select(
        "before", null.alias("word"), context_ratio, F.lit(0.0), F.col("seen0") + F.col("seen1")
    )

    @returning
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [batch.column(c) for c in ("before", "word")]
            kinds = _keys(*[c.fill_null(0).to_numpy().view(_U) for c in given])
            lacks = [c.is_null().to_numpy(zero_copy_only=False) for c in given]
            key = np.select(lacks, kinds[:2], kinds[2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(~(lacks[0] | lacks[1])), *(batch.column(i) for i in (2, 3, 4))],
                names=["key", "pair", "value", "clear", "n"],
            )

    every = own.union(plain).union(contexts)
    entries = stored(every.mapInArrow(keyed, "key bigint, pair boolean, value double, clear double, n bigint"), "entries")
    least = (n0 + n1) / COMMON
    common = entries.where(F.col("n") >= least).orderBy("key").toArrow()
    rest = entries.where(F.col("n") < least)
    bit = F.col("key").bitwiseAND(FILTER_BITS - 1)
    places = rest.where("NOT pair").select(bit.alias("bit"))
    places = places.selectExpr("CAST(bit DIV 8 AS INT) AS byte", "shiftleft(1, CAST(bit % 8 AS INT)) AS bits")
    places = places.groupBy("byte").agg(F.bit_or("bits").cast("short").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    bits[places.column("byte").to_numpy()] = places.column("bits").to_numpy().astype(np.uint8)
    discard(all_words, by_context)
    values = np.stack([common.column(c).to_numpy() for c in ("value", "clear")])
    return Model(rest.select("key", "value", "clear"), common.column("key").to_numpy(), values, bits, unseen)


def _looked_up(shared, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per row the sums over common entries and the number of words; (row, key, times) to look up."""
    common, values, bits, unseen = shared
    before, word, rows = _bigrams(data, bounds)
    n = len(bounds) - 1
    sizes = np.bincount(rows, minlength=n)
    sums, asked = np.stack([sizes * unseen, np.zeros(n)]), []
    counted = np.ones(len(word), bool)
    for kind, key in enumerate(_keys(before, word)):
        known = np.zeros(len(key), bool)
        if len(common):
            at = np.minimum(np.searchsorted(common, key), len(common) - 1)
            known = common[at] == key
            for total, value in zip(sums, values, strict=True):
                total += np.bincount(rows[known], value[at[known]], n)
        if kind < 2:
            bit = key & (FILTER_BITS - 1)
            maybe = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            counted &= known | maybe
        else:
            # A bigram is counted only if its word and its context are.
            maybe = counted
        asked.append((key[maybe & ~known], rows[maybe & ~known]))
    key, row = (np.concatenate(x) for x in zip(*asked, strict=True))
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    first = np.flatnonzero((np.diff(row, prepend=-1) != 0) | np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    times = np.diff(first, append=len(key))
    return sums, sizes, row[first], key[first], times


def with_ratio(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` (and ``toxic`` where there is one) with ``ratio`` and ``clear``, a row for each row.

    The ratio is the difference of the log-likelihoods per word; both are 0 without words.
    """
    given = (model.keys, model.values, model.bits, model.unseen)
    shared = docs.sparkSession.sparkContext.broadcast(given)
    names = [c for c in ("doc_id", "toxic") if c in docs.columns]
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"), *[F.col(c).cast("bigint") for c in names], "text"
    )

    @returning
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("_row").to_numpy()
            for low, data, bounds in text_chunks(batch.column("text")):
                sums, n, row, key, times = _looked_up(shared.value, data, bounds)
                own, none = ids[low : low + len(n)], np.zeros(len(key))
                # A row of its own for each text, under a key that no entry has but by chance.
                head = folded([own.view(_U)] * 4).view(np.int64)
                columns = [
                    np.concatenate(x)
                    for x in ((own, own[row]), (head, key), (-1 - n, times), (sums[0], none), (sums[1], none))
                ]
                given = [pa.concat_arrays([batch.column(c).slice(low, len(n)), pa.nulls(len(key), pa.int64())]) for c in names]
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, columns), *given],
                    names=["_row", "key", "times", "base", "base_clear", *names],
                )

    schema = "_row bigint, key bigint, times bigint, base double, base_clear double"
    asked = rows.mapInArrow(run, ", ".join([schema, *[f"{c} bigint" for c in names]]))
    met = asked.join(model.entries.hint("merge"), "key", "left")
    own = F.col("times") < 0
    sums = [
        F.sum(F.when(own, F.col(base)).otherwise(F.col("times") * F.coalesce(value, F.lit(0.0)))).alias(value)
        for base, value in (("base", "value"), ("base_clear", "clear"))
    ]
    n_words = F.sum(F.when(own, -1 - F.col("times")))
    every = met.groupBy("_row").agg(n_words.alias("n_words"), *sums, *[F.max(c).alias(c) for c in names])
    size = F.greatest("n_words", F.lit(1))
    return every.select(*names, (F.col("value") / size).alias("ratio"), (F.col("clear") / size).alias("clear"))


def _root(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.sqrt(np.abs(x))


def fit_curve(features: np.ndarray, toxic: np.ndarray) -> tuple[list[float], list[float], float]:
    """Shifts, scales and offset of the logistic curve over the features' signed roots.

    ``features`` has a row for each document. By Newton's method, slightly
    ridged; the root tames short texts.
    """
    width = features.shape[1]
    if not len(features):
        return [0.0] * width, [1.0] * width, 0.0
    x = _root(features)
    shift, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1.0
    x = np.concatenate([(x - shift) / spread, np.ones((len(x), 1))], axis=1)
    w = np.zeros(width + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(width + 1) * 1e-2
        w = w + np.linalg.solve(curve, x.T @ (toxic - p) - 1e-2 * w)
    return shift.tolist(), (w[:-1] / spread).tolist(), float(w[-1])


def train(docs: DataFrame, labels: DataFrame):
    """Counts from three quarters of the labelled documents, the curve from the rest.

    A document is toxic if any of its labels is 1; null labels and ids are left
    out. Both classes are counted over whole texts.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    marks = marks.select(F.col("doc_id").cast("bigint"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    marks = marks.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = stored(marks, "marks")
    bits = id_filter(marks)
    # Texts are shuffled to their labels once, and never stored again.
    curve = F.crc32(F.col("doc_id").cast("string")) % 5 == 4
    counted = passing(docs.where(F.col("doc_id").isNotNull() & ~curve), bits)
    bigrams = count_bigrams(counted.join(marks, "doc_id"))
    model = build_model(bigrams)
    discard(bigrams)
    ids = docs.where(curve).select(F.col("doc_id").cast("bigint").alias("doc_id"))
    total = ids.join(marks, "doc_id").count()
    # By id and text, so that rows of one id are drawn apart.
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.lit(
        int(min(1.0, CURVE_DOCS / max(1, total)) * (1 << 20))
    )
    drawn = with_ratio(passing(docs.where(curve & share), bits).join(marks, "doc_id"), model).toArrow()
    discard(marks)
    features = np.stack([drawn.column(c).to_numpy() for c in ("ratio", "clear")], axis=1)
    return model, fit_curve(features, drawn.column("toxic").to_numpy().astype(np.float64))


def score(docs: DataFrame, model: Model, curve: tuple[list[float], list[float], float]) -> DataFrame:
    """``doc_id, ratio, clear, score, predicted``: one row for each row, from the whole text.

    Null and empty texts have ratio 0 and the score that it has. Repeated rows
    and null ids are kept; other columns are ignored.
    """
    shifts, scales, line = curve[0], curve[1], F.lit(curve[2])
    for name, shift, scale in zip(("ratio", "clear"), shifts, scales, strict=True):
        root = F.signum(name) * F.sqrt(F.abs(name))
        line = line + (root - F.lit(shift)) * F.lit(scale)
    found = with_ratio(docs.select("doc_id", "text"), model)
    scored = found.withColumn("score", 1 / (1 + F.exp(-line)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
