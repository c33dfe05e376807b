"""Exact area under the ROC and the precision-recall curve.

Both need a running total over all rows in score order. A window without a
partition key would run in one task, so the total is built in two levels:

1. rows are reduced to one row per distinct score (map-side, so a score shared
   by a third of the rows is one row per task) and written once;
2. distinct scores are cut into ranges of about equal size; running totals are
   taken inside a range, and the totals of the ranges before it are added.

The only unpartitioned step is over the range totals, one for each million
distinct scores and group. Every size of input takes this plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from flowscore.functions.confusion import share
from flowscore.functions.names import column, quote_all, quoted
from flowscore.operators.metrics import as_array
from flowscore.session import stage_table

ROWS_PER_RANGE = 1_000_000


def _score_counts(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score; vectors give the score of class 1."""
    plain = isinstance(df.schema[score].dataType, NumericType)
    value = column(score).cast("double") if plain else F.get(as_array(df, score), F.lit(1))
    counts = (
        df.select(*quote_all(by), value.alias("__s"), column(label).cast("double").alias("__y"))
        .groupBy(*quote_all(by), "__s")
        .agg(
            F.expr("count_if(__y > 0.5) AS __pos"),
            F.expr("count_if(NOT __y > 0.5) AS __neg"),
        )
    )
    # Rows without score or label are dropped from the written table: before
    # it, the filter would compute a model's score twice for every row.
    written = stage_table(counts, "scores")
    return written.filter("__s IS NOT NULL AND __pos + __neg > 0")


def _range_splits(scores: DataFrame, rows_per_range: int) -> list[float]:
    """Bounds of at least two ranges over the written ``scores``."""
    wanted = max(2, -(-scores.count() // rows_per_range))
    steps = [step / wanted for step in range(1, wanted)]
    cuts = scores.approxQuantile("__s", steps, 1.0 / (4 * wanted))
    ends = {float("-inf"), float("inf")}
    return [float("-inf"), *(sorted(set(cuts) - ends) or [0.0]), float("inf")]


def _running_totals(keys: Sequence[str]) -> list[Column]:
    """Positives and negatives at or above each score, inside ``keys``."""
    down = (
        W.partitionBy(*keys)
        .orderBy(F.desc("__s"))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return [F.sum("__pos").over(down).alias("__tp"), F.sum("__neg").over(down).alias("__fp")]


def _curve_over_ranges(scores: DataFrame, by: Sequence[str], splits: list[float]) -> DataFrame:
    group = quote_all(by)
    # NaN sorts above every number, and "keep" gives it the range above all others.
    ranged = Bucketizer(
        splits=splits, inputCol="__s", outputCol="__range", handleInvalid="keep"
    ).transform(scores)
    ranged = ranged.withColumn("__range", F.col("__range").cast("int"))
    running = ranged.select("*", *_running_totals([*group, "__range"]))
    totals = ranged.groupBy(*group, "__range").agg(
        F.sum("__pos").alias("__rp"), F.sum("__neg").alias("__rn")
    )
    higher = (
        W.partitionBy(*group).orderBy(F.desc("__range")).rowsBetween(W.unboundedPreceding, -1)
    )
    whole = W.partitionBy(*group)
    offsets = totals.select(
        *group,
        "__range",
        F.coalesce(F.sum("__rp").over(higher), F.lit(0)).alias("__tp0"),
        F.coalesce(F.sum("__rn").over(higher), F.lit(0)).alias("__fp0"),
        F.sum("__rp").over(whole).alias("__P"),
        F.sum("__rn").over(whole).alias("__N"),
    )
    # Ranges are never null, group values may be.
    same_range = [F.col("r.__range") == F.col("o.__range")]
    same_group = [F.col(f"r.{q}").eqNullSafe(F.col(f"o.{q}")) for q in map(quoted, by)]
    joined = running.alias("r").join(offsets.alias("o"), same_range + same_group)
    return joined.select(
        *[F.col(f"r.{quoted(name)}") for name in scores.columns],
        (F.col("__tp") + F.col("__tp0")).alias("__tp"),
        (F.col("__fp") + F.col("__fp0")).alias("__fp"),
        "__P",
        "__N",
    )


def ranking_metrics(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """``areaUnderROC`` and ``areaUnderPR``; a label above 0.5 is positive.

    Runs a job when called: the distinct scores are written to the shared
    folder and everything else reads them from there. The areas are null when
    a class is missing.
    """
    scores = _score_counts(df, label, score, by)
    splits = _range_splits(scores, rows_per_range)
    curve = _curve_over_ranges(scores, by, splits)
    points = curve.selectExpr(
        *quote_all(by),
        *[f"CAST({c} AS DOUBLE) AS {c[2:]}" for c in ("__tp", "__fp", "__pos", "__neg")],
        "__P",
        "__N",
    )
    # The precision before this score; the curve starts at recall 0 with the
    # precision of its first point.
    precision, seen = "tp / (tp + fp)", "tp - pos + fp - neg"
    previous = f"CASE WHEN {seen} > 0 THEN (tp - pos) / ({seen}) ELSE {precision} END"
    roc = "sum(neg * (tp - pos / 2))"
    pr = f"sum(CASE WHEN pos > 0 THEN pos * ({precision} + {previous}) / 2 ELSE 0D END)"
    all_pos, all_neg = "max(CAST(__P AS DOUBLE))", "max(CAST(__N AS DOUBLE))"
    return points.groupBy(*quote_all(by)).agg(
        F.expr(share(roc, f"{all_pos} * {all_neg}", empty="NULL")).alias("areaUnderROC"),
        F.expr(share(pr, all_pos, empty="NULL")).alias("areaUnderPR"),
    )
