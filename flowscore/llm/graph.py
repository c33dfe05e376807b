"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscore.llm.scratch import discard, stored


def _star(edges: DataFrame, label: str, large: bool) -> DataFrame:
    """Tie the neighbours of every node to the least of them.

    ``edges`` has ``a`` > ``b``. The large star looks at all neighbours and
    moves those above the node, the small star at those below it.
    """
    if large:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    tied = seen.join(least, "a")
    if large:
        moved = tied.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = tied.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return stored(moved.where("a > b").distinct(), label)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a")
    ).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (``a``, ``b``, integers).

    The component is its smallest node. Loops and repeated edges are allowed.
    Every round is written to the shared folder, so a lost executor costs a
    re-read. Each round is two groupings and two joins on a node, aggregated
    before the shuffle, so a node with very many edges is no single task.
    """
    now = edges.where("a <> b").select(
        F.greatest("a", "b").cast("bigint").alias("a"), F.least("a", "b").cast("bigint").alias("b")
    )
    now = stored(now.distinct(), "edges")
    before = None
    state = _state(now)
    while state[0] and state != before:
        large = _star(now, "edges", large=True)
        discard(now)
        now = _star(large, "edges", large=False)
        discard(large)
        before, state = state, _state(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    # For ``discard``, when the components have been used.
    found.stored_path = now.stored_path
    return found
