"""Exact largest inner products through a pivot-distance index.

Vectors get one more coordinate that gives all of them the same norm, so that
a large inner product with a query is a small distance to it. Each is filed
under its nearest pivot, by its distance to that pivot, in lists of sorted
distance that are cut into annuli. An annulus whose distances lie in ``[low,
high]`` holds nothing nearer to a query at distance ``d`` from the pivot than
``max(low - d, d - high)``. Queries go to their nearest pivot, then in rounds to
those farther away; inside a list the annuli are visited outward from the
queries, the k-th best score so far, the floor, rises after each, and the search
stops where no bound reaches a floor. Between rounds the floors of all lists are
merged, and only pivots that may still hold a better vector are asked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowscore.llm.scratch import discard, stored

PIVOTS = 64
PIVOT_SAMPLE = 4096
# Vectors of an annulus, and bytes of a list of annuli, which one task holds.
ANNULUS_ROWS = 256
LIST_BYTES = 1 << 22
# Queries that are sent to a list together, on average at most.
QUERY_ROWS = 256
# Pivots of each round, nearest first; the last takes all that are left.
ROUNDS = (1, 7, PIVOTS)
NO_FLOOR = -(2**63)
SCALE = 1024


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: components as ``floor(scale * x)``; unusable vectors left out.

    Unusable are null and empty vectors, those with a null, NaN or infinite
    component, and those whose scaled squares sum up to 2^62 or more: all inner
    products of the others fit into 64 bits. Vectors of fewer components than
    the longest are filled up with zeros.
    """
    x = F.col("embedding").cast("array<double>")
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    step = F.lit(float(scale))
    square = F.aggregate(x, F.lit(0.0), lambda a, c: a + c * step * c * step)
    # One more for each component: floor may go a step outward.
    fits = F.sqrt(square) + F.sqrt(F.size(x)) < float(2**31)
    known = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(F.size(x) > 0)
    known = known.select(F.col("vec_id").cast("bigint"), x.alias("x"), (usable & fits).alias("usable"))
    v = F.transform("x", lambda c: F.floor(c * step).cast("bigint"))
    return known.where("usable").select("vec_id", v.alias("v"))


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


def _lifted(v: np.ndarray, norm2: float) -> np.ndarray:
    """With the coordinate that makes every squared norm ``norm2``."""
    x = v.astype(np.float64)
    rest = np.maximum(norm2 - (x * x).sum(axis=1), 0.0)
    return np.hstack([x, np.sqrt(rest)[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0.0))


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products: float64 where that is exact, else integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q @ v.T


def build_index(rows: DataFrame, dim: int, norm2: float):
    """The broadcast pivots and lists ``pivot, salt, gaps, ids, vectors`` in order of gap, stored.

    Pivots are vectors of the table, drawn by a hash of the id from a sample of
    at most PIVOT_SAMPLE rows; every vector is indexed. A pivot with more
    vectors than a list holds, equal ones included, is salted over lists.
    """
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).toArrow()
    drawn = _matrix(sample.column("v"), dim)
    _, first = np.unique(drawn, axis=0, return_index=True)
    pivots = spark.sparkContext.broadcast(_lifted(drawn[np.sort(first)][:PIVOTS], norm2))

    def file_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = _distances(_lifted(_matrix(batch.column("v"), dim), norm2), pivots.value)
            near = gaps.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("v"),
                    pa.array(near, pa.int32()),
                    pa.array(gaps[np.arange(len(near)), near], pa.float64()),
                ],
                names=["vec_id", "v", "pivot", "gap"],
            )

    filed = stored(
        rows.mapInArrow(file_rows, "vec_id bigint, v array<bigint>, pivot int, gap double"), "filed"
    )
    list_rows = max(1, LIST_BYTES // (8 * (dim + 2)))
    salts = filed.groupBy("pivot").agg(F.ceil(F.count("*") / list_rows).alias("salts"))
    salt = F.pmod(F.xxhash64("vec_id"), F.col("salts")).alias("salt")
    salted = filed.join(F.broadcast(salts), "pivot").groupBy("pivot", salt)
    lists = salted.agg(F.array_sort(F.collect_list(F.struct("gap", "vec_id", "v"))).alias("members"))
    lists = lists.select(
        "pivot",
        "salt",
        F.col("members.gap").alias("gaps"),
        F.col("members.vec_id").alias("ids"),
        F.flatten("members.v").alias("vectors"),
    )
    lists = stored(lists, "annuli")
    discard(filed)
    return pivots, lists


def _reachable(square: np.ndarray, away: np.ndarray, low, high, norm2: float) -> np.ndarray:
    """The largest inner product that a query may have in an annulus.

    ``|q - x|^2 = |q|^2 + norm2 - 2 q.x``; the slack covers rounding of distances.
    """
    bound = np.maximum(np.maximum(low - away, away - high), 0.0)
    return (square + norm2 - bound**2) / 2 + 1e-6 * norm2 + 1


def expand(
    q_ids: np.ndarray,
    q: np.ndarray,
    away: np.ndarray,
    floors: np.ndarray,
    ids: np.ndarray,
    v: np.ndarray,
    gaps: np.ndarray,
    k: int,
    norm2: float,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, place in the list, score) of each query's k best in a list, and annuli visited.

    The annuli are visited outward from the queries. What lies under a query's
    floor is left out; a floor rises with the k best scores of the list.
    """
    first = np.arange(0, len(ids), ANNULUS_ROWS)
    last = np.minimum(first + ANNULUS_ROWS, len(ids)) - 1
    square = (q.astype(np.float64) ** 2).sum(axis=1)[:, None]
    best = _reachable(square, away[:, None], gaps[first][None, :], gaps[last][None, :], norm2)
    top = np.full((len(q), k), NO_FLOOR, np.int64)
    floors, found, visited = floors.copy(), [], 0
    order = np.argsort(-best.max(axis=0), kind="stable")
    for at, annulus in enumerate(order):
        if not (best[:, order[at:]] >= floors[:, None]).any():
            break
        live = np.flatnonzero(best[:, annulus] >= floors)
        if not len(live):
            continue
        visited += 1
        low, high = first[annulus], last[annulus] + 1
        scores = _products(q[live], v[low:high])
        scores[ids[None, low:high] == q_ids[live][:, None]] = NO_FLOOR
        joint = np.hstack([top[live], scores])
        top[live] = np.partition(joint, joint.shape[1] - k, axis=1)[:, -k:]
        floors[live] = np.maximum(floors[live], top[live].min(axis=1))
        row, place = np.nonzero((scores > NO_FLOOR) & (scores >= floors[live][:, None]))
        found.append((live[row], low + place, scores[row, place]))
    if not found:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing, visited
    row, place, score = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = score >= floors[row]
    row, place, score = row[keep], place[keep], score[keep]
    ranked = np.lexsort((ids[place], -score, row))
    row, place, score = row[ranked], place[ranked], score[ranked]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], place[keep], score[keep], visited


def top_products(
    vectors: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each query.

    Queries are the rows whose ``vec_id`` is divisible by ``every``, candidates
    all rows but the query's own, scores inner products of the scaled integer
    vectors, ties to the smaller ``vec_id``. A query with fewer candidates gets
    all. Rows without id, and vectors that ``scaled`` leaves out, take no part.
    Rows that repeat a ``vec_id`` count once for each distinct vector. Other
    columns are ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = stored(scaled(vectors, scale).distinct(), "vectors")
    square = F.aggregate("v", F.lit(0).cast("bigint"), lambda a, x: a + x * x)
    dim, norm2 = rows.agg(F.max(F.size("v")), F.max(square)).first()
    if not dim:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    norm2 = float(norm2)
    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(dim) - F.size("v"))
    padded = rows.select("vec_id", F.concat("v", zeros).alias("v"))
    pivots, lists = build_index(padded, dim, norm2)

    def place_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pivots in order of their distance from each query."""
        for batch in batches:
            q = _matrix(batch.column("v"), dim).astype(np.float64)
            away = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots.value)
            near = np.argsort(away, axis=1, kind="stable")
            away = np.take_along_axis(away, near, axis=1)
            bounds = pa.array(np.arange(len(q) + 1) * away.shape[1], pa.int32())
            listed = [pa.ListArray.from_arrays(bounds, pa.array(x.ravel())) for x in (near, away)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((q**2).sum(axis=1)), *listed],
                names=["query_id", "q", "square", "near", "away"],
            )

    queries = padded.where(F.col("vec_id") % every == 0).mapInArrow(
        place_queries,
        "query_id bigint, q array<bigint>, square double, near array<bigint>, away array<double>",
    )
    queries = stored(queries, "queries")
    groups = queries.count() // QUERY_ROWS + 1
    reach = lists.groupBy("pivot").agg(
        F.min(F.get("gaps", F.lit(0))).alias("low"),
        F.max(F.element_at("gaps", -1)).alias("high"),
        F.count("*").alias("salts"),
    )
    reach = F.broadcast(reach)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell in batch.itertuples(index=False):
                q_ids, ids = np.asarray(cell.query_ids), np.asarray(cell.ids)
                row, place, score, _ = expand(
                    q_ids,
                    np.asarray(cell.queries).reshape(-1, dim),
                    np.asarray(cell.aways, np.float64),
                    np.asarray(cell.floors, np.int64),
                    ids,
                    np.asarray(cell.vectors).reshape(-1, dim),
                    np.asarray(cell.gaps, np.float64),
                    k,
                    norm2,
                )
                if len(row):
                    yield pd.DataFrame({"query_id": q_ids[row], "vec_id": ids[place], "score": score})

    best, before = None, 0
    for size in ROUNDS:
        if before >= len(pivots.value):
            break
        near = F.explode(F.arrays_zip(*[F.slice(c, before + 1, size).alias(c) for c in ("near", "away")]))
        asked = queries.select("query_id", "q", "square", near.alias("at"))
        asked = asked.select("query_id", "q", "square", F.col("at.near").alias("pivot"), F.col("at.away").alias("away"))
        floor = F.lit(NO_FLOOR).cast("bigint")
        if best is not None:
            full = F.when(F.count("*") >= k, F.min("score")).alias("floor")
            asked = asked.join(best.groupBy("query_id").agg(full).hint("merge"), "query_id", "left")
            floor = F.coalesce("floor", floor)
        asked = asked.withColumn("floor", floor).join(reach, "pivot")
        bound = F.greatest(F.col("low") - F.col("away"), F.col("away") - F.col("high"), F.lit(0.0))
        reachable = (F.col("square") + norm2 - bound * bound) / 2 + (1e-6 * norm2 + 1)
        cells = asked.where(reachable >= F.col("floor")).groupBy(
            "pivot", "salts", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("group")
        )
        cells = cells.agg(F.collect_list(F.struct("query_id", "away", "floor", "q")).alias("asked"))
        cells = cells.select(
            "pivot",
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"),
            F.col("asked.query_id").alias("query_ids"),
            F.col("asked.away").alias("aways"),
            F.col("asked.floor").alias("floors"),
            F.flatten("asked.q").alias("queries"),
        )
        found = cells.join(lists.hint("merge"), ["pivot", "salt"]).mapInPandas(
            search, "query_id bigint, vec_id bigint, score bigint"
        )
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        rank = F.row_number().over(order).cast("int").alias("rank")
        last, best = best, stored(found.select("query_id", rank, "vec_id", "score").where(f"rank <= {k}"), "best")
        discard(last)
        before += size
    discard(rows, queries, lists)
    return best
