import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import plan_of
from flowscore.operators.sampling import (
    bernoulli_sample,
    hash_split,
    repartition_dataset,
)


def test_sample_seed_counts(spark):
    df = spark.range(0, 2000, 1, 4)
    first = [r.id for r in bernoulli_sample(df, 0.5, 42).collect()]
    assert first == [r.id for r in bernoulli_sample(df, 0.5, 42).collect()]
    assert first != [r.id for r in bernoulli_sample(df, 0.5, 43).collect()]
    assert 800 < len(first) < 1200
    assert "Sample 0.0, 0.5, false, 42" in bernoulli_sample(df, 0.5, 42)._jdf.queryExecution().toString()


def test_split_is_disjoint_complete_and_stable(spark):
    df = spark.range(3000).withColumn("t", F.when(F.col("id") % 5 > 0, F.col("id").cast("string")))
    for keys in ("id", ["t", "id"], ["t"]):
        first, second = hash_split(df, keys, 0.7, seed=7)
        a, b = {r.id for r in first.collect()}, {r.id for r in second.collect()}
        assert not a & b and a | b == set(range(3000))
        moved, _ = hash_split(df.repartition(13), keys, 0.7, seed=7)
        assert {r.id for r in moved.collect()} == a
    digests = {i: hashlib.md5(f"7|{i}".encode()).hexdigest()[:8] for i in range(3000)}
    first, _ = hash_split(df, "id", 0.7, seed=7)
    assert {r.id for r in first.collect()} == {i for i, d in digests.items() if d < "b3333333"}


def test_split_bounds(spark):
    df = spark.range(100)
    assert [part.count() for part in hash_split(df, "id", 1.0)] == [100, 0]
    assert [part.count() for part in hash_split(df, "id", 0.0)] == [0, 100]
    with pytest.raises(ValueError, match="ratio"):
        hash_split(df, "id", 1.5)
    assert "Exchange" not in plan_of(hash_split(df, "id", 0.5)[0])


def test_repartition_follows_parallelism_not_the_scan(spark):
    usual = spark.sparkContext.defaultParallelism * 2
    for split in (2, usual + 3):
        df = spark.range(0, 1000, 1, split)
        assert repartition_dataset(df).rdd.getNumPartitions() == usual
    assert repartition_dataset(df, 5).rdd.getNumPartitions() == 5
