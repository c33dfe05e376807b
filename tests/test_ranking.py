import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from conftest import plan_of
from flowscore.operators.ranking import ranking_metrics


def brute_force(pairs):
    """Areas by the definitions, over (label, score) pairs."""
    pos = [s for y, s in pairs if y > 0.5]
    neg = [s for y, s in pairs if y <= 0.5]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    roc = wins / (len(pos) * len(neg)) if pos and neg else None
    points, area = [], 0.0
    for cut in sorted({s for _, s in pairs}, reverse=True):
        tp = sum(p >= cut for p in pos)
        points.append((tp / len(pos), tp / (tp + sum(n >= cut for n in neg))) if pos else None)
    if not pos:
        return roc, None
    points = [(0.0, points[0][1]), *points]
    for (r0, p0), (r1, p1) in zip(points, points[1:]):
        area += (r1 - r0) * (p0 + p1) / 2
    return roc, area


@pytest.fixture(scope="module")
def scored(spark):
    # A third of the rows share one score.
    return spark.range(900).select(
        F.expr("IF(id % 3 = 0, 0.5D, (id * 7919 % 251) / 251D)").alias("s"),
        (F.col("id") * 31 % 5 < 2).cast("double").alias("y"),
        (F.col("id") % 2).alias("g"),
    )


def test_golden_five_rows(spark):
    rows = [(1.0, 0.9), (1.0, 0.4), (0.0, 0.1), (0.0, 0.6), (0.0, 0.3)]
    row = ranking_metrics(spark.createDataFrame(rows, "y DOUBLE, s DOUBLE"), "y", "s").first()
    assert tuple(row) == pytest.approx((0.8333333333, 0.7916666667), abs=1e-9)


@pytest.mark.parametrize("rows_per_range", [1_000_000, 40, 7])
def test_any_number_of_ranges_gives_the_exact_areas(scored, rows_per_range):
    expected = brute_force([(r.y, r.s) for r in scored.collect()])
    row = ranking_metrics(scored, "y", "s", rows_per_range=rows_per_range).first()
    assert tuple(row) == pytest.approx(expected, abs=1e-12)


def test_agrees_with_mllib(scored):
    vectors = scored.withColumn("raw", array_to_vector(F.array(1 - F.col("s"), F.col("s"))))
    row = ranking_metrics(vectors, "y", "raw", rows_per_range=50).first()
    for metric in ("areaUnderROC", "areaUnderPR"):
        evaluator = BinaryClassificationEvaluator(
            labelCol="y", rawPredictionCol="raw", metricName=metric, numBins=0
        )
        assert row[metric] == pytest.approx(evaluator.evaluate(vectors), abs=1e-12)


def test_groups_nulls_and_missing_classes(spark, scored):
    grouped = scored.withColumn("g", F.when(F.col("g") == 1, "one")).unionByName(
        spark.createDataFrame(
            [(0.1, 1.0, "only positives"), (0.2, 1.0, "only positives"), (0.3, 0.0, "neg")],
            "s DOUBLE, y DOUBLE, g STRING",
        )
    )
    grouped = grouped.unionByName(
        spark.createDataFrame([(None, 1.0, "one"), (0.5, None, "one")], grouped.schema)
    )
    rows = ranking_metrics(grouped, "y", "s", by=["g"], rows_per_range=30).collect()
    got = {r.g: (r.areaUnderROC, r.areaUnderPR) for r in rows}
    parts = {}
    for r in grouped.dropna(subset=["s", "y"]).collect():
        parts.setdefault(r.g, []).append((r.y, r.s))
    assert set(got) == set(parts) == {None, "one", "only positives", "neg"}
    for key, pairs in parts.items():
        for ours, exact in zip(got[key], brute_force(pairs)):
            assert ours is None if exact is None else ours == pytest.approx(exact, abs=1e-12)


def test_infinite_and_nan_scores_keep_their_place(spark):
    inf = float("inf")
    rows = [(1.0, inf), (0.0, -inf), (1.0, 0.2), (0.0, 0.1), (0.0, float("nan")), (1.0, 0.3)]
    df = spark.createDataFrame(rows, "y DOUBLE, s DOUBLE")
    # NaN sorts above every other score.
    expected = brute_force([(y, 1e300 if s != s else max(min(s, 1e299), -1e299)) for y, s in rows])
    for size in (100, 2):
        got = ranking_metrics(df, "y", "s", rows_per_range=size).first()
        assert tuple(got) == pytest.approx(expected, abs=1e-12)


def test_no_cross_join_and_the_data_is_read_once(scored):
    for size in (1_000_000, 40):
        plan = plan_of(ranking_metrics(scored, "y", "s", rows_per_range=size))
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert "Range (0, 900" not in plan  # reads the written scores only
