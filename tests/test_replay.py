import pytest
from pyspark.sql import functions as F

from flowscore.operators import paging
from flowscore.operators.paging import number_rows, paginate
from flowscore.sinks import text_sink
from flowscore.streaming.replay import replay, replay_batches, replay_positive_counts


@pytest.fixture(scope="module")
def flows(spark):
    # A third of the rows share key 7; keys also repeat elsewhere, one is null.
    return spark.range(0, 3000, 1, 5).select(
        F.expr("IF(id % 3 = 0, 7, IF(id = 1, NULL, id * 7919 % 500))").alias("key"),
        F.col("id"),
        (F.col("id") % 4 == 0).cast("double").alias("Label"),
    )


def in_order(df):
    return [(r.key, r.id) for r in df.orderBy("row_no").collect()]


def test_numbers_are_consecutive_and_follow_the_key(flows):
    numbered = number_rows(flows, ["key", "id"])
    assert sorted(r.row_no for r in numbered.collect()) == list(range(3000))
    expected = [(r.key, r.id) for r in flows.orderBy("key", "id").collect()]
    assert in_order(numbered) == expected


@pytest.mark.parametrize("first", [1, 10, 999, 1500, 3000, 5000])
@pytest.mark.parametrize("order", [["id"], ["key", "id"]])
def test_first_rows_are_exact(flows, first, order):
    expected = [(r.key, r.id) for r in flows.orderBy(*order).limit(first).collect()]
    assert in_order(number_rows(flows, order, first=first)) == expected


def test_cutoff_only_drops_rows_that_cannot_win(flows):
    kept = paging._before_cutoff(flows, F.col("id"), 100)
    assert 100 <= kept.count() < 110
    assert kept.agg(F.max("id")).first()[0] < 110
    with_null = paging._before_cutoff(flows, F.col("key"), 5)
    assert with_null.filter("key IS NULL").count() == 1
    same = flows.withColumn("same", F.lit(1))
    assert paging._before_cutoff(same, F.col("same"), 5).count() == 3000


def test_cutoff_is_refined_where_far_values_make_it_coarse(spark):
    df = spark.range(0, 20_000, 1, 4).withColumn("id", F.expr("IF(id = 5, 1L << 60, id)"))
    kept = paging._before_cutoff(df, F.col("id"), 100)
    assert 100 <= kept.count() < 120
    got = [r.id for r in number_rows(df, ["id"], first=100).orderBy("row_no").collect()]
    assert got == [i for i in range(101) if i != 5]


LEADS = {
    "time": "timestamp_micros(id * 1000003)",
    "plain_time": "CAST(timestamp_micros(id * 1000003) AS TIMESTAMP_NTZ)",
    "day": "date_from_unix_date(CAST(id - 3000 AS INT))",
    "text": "lpad(CAST(id AS STRING), 6, '0')",
    "small": "CAST(id AS DECIMAL(20, 3)) / 7",
    "holes": "CASE id % 50 WHEN 3 THEN DOUBLE('NaN') WHEN 5 THEN DOUBLE('Infinity') ELSE id END",
    "low": "CASE id % 1000 WHEN 3 THEN DOUBLE('-Infinity') WHEN 5 THEN NULL ELSE id END",
    "endless": "CASE id % 2 WHEN 0 THEN DOUBLE('-Infinity') ELSE DOUBLE('NaN') END",
}


@pytest.mark.parametrize("name", LEADS)
@pytest.mark.parametrize("first", [1, 100, 9_995, 20_000])
def test_cutoff_of_every_kind_of_key_keeps_the_first_rows(spark, name, first):
    df = spark.range(0, 10_000, 1, 4).select(F.expr(LEADS[name]).alias("lead"), "id")
    kept = paging._before_cutoff(df, F.col("lead"), first)
    wanted = df.orderBy("lead", "id").limit(first)
    assert wanted.select("id").subtract(kept.select("id")).count() == 0
    if first == 100 and name not in ("endless", "plain_time"):
        assert kept.count() < 300


def test_first_rows_by_time_or_by_endless_keys(spark):
    for name in ("time", "holes", "endless"):
        df = spark.range(0, 3000, 1, 4).select(F.expr(LEADS[name]).alias("lead"), "id")
        numbered = number_rows(df, ["lead", "id"], first=200)
        got = [r.id for r in numbered.orderBy("row_no").collect()]
        assert got == [r.id for r in df.orderBy("lead", "id").limit(200).collect()]


def test_copies_and_hot_keys_spread_over_partitions(spark):
    copies = spark.range(0, 6000, 1, 4).select(F.lit(1).alias("key"), F.lit("x").alias("v"))
    numbered = number_rows(copies, ["key"])
    assert sorted(r.row_no for r in numbered.collect()) == list(range(6000))
    hot = spark.range(0, 6000, 1, 4).select(F.lit(1).alias("key"), F.col("id"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for df in (copies, hot):
            order = [F.col("key"), F.col("__content"), F.col("__source")]
            slots = paging._sorted_slots(paging._placed(df), order, df.columns)
            sizes = slots.groupBy(F.shiftright("__slot", paging.SLOT_BITS)).count().collect()
            assert len(sizes) == 8
            assert max(r["count"] for r in sizes) < 2 * 6000 / 8
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_order_by_content_makes_ties_repeatable(flows):
    one = in_order(number_rows(flows, ["key"]))
    assert one == in_order(number_rows(flows.repartition(3), ["key"]))


def test_shuffled_order_is_seeded(flows):
    plain = in_order(number_rows(flows, ["id"]))
    one = in_order(number_rows(flows, ["id"], shuffle_seed=1))
    assert sorted(one, key=lambda r: r[1]) == sorted(plain, key=lambda r: r[1])
    assert one != plain
    assert one == in_order(number_rows(flows.repartition(7), ["id"], shuffle_seed=1))
    assert one != in_order(number_rows(flows, ["id"], shuffle_seed=2))
    assert in_order(number_rows(flows, ["id"], first=50, shuffle_seed=1)) == one[:50]


def test_pages(flows):
    pages = paginate(flows, 700, ["id"])
    sizes = {r.batch_no: r["count"] for r in pages.groupBy("batch_no").count().collect()}
    assert sizes == {0: 700, 1: 700, 2: 700, 3: 700, 4: 200}
    assert paginate(flows, 700, ["id"], pages=2).count() == 1400
    with pytest.raises(ValueError, match="positive"):
        paginate(flows, 0, ["id"])


def test_batches_and_positive_counts(flows):
    batches = replay_batches(flows, 1000, ["id"], batches=2)
    assert batches.columns == ["batch_no", "row_no", "value"]
    assert batches.orderBy("row_no").first().value == "7,0,1.0"
    counts = replay_positive_counts(flows, 1000, ["id"], batches=2).orderBy("batch_no").collect()
    assert [tuple(r) for r in counts] == [(0, 1000, 250), (1, 1000, 250)]


def test_counts_belong_to_the_same_batches_as_the_rows(flows):
    # Keys are not unique: both have to break ties alike.
    counts = replay_positive_counts(flows, 450, ["key"]).collect()
    pages = paginate(flows, 450, ["key"]).groupBy("batch_no").agg(F.sum("Label").alias("p"))
    assert {r.batch_no: r.positives for r in counts} == {r.batch_no: r.p for r in pages.collect()}
    assert number_rows(flows, ["key"], carry=["Label"]).columns == ["row_no", "Label"]


def test_replay_sends_every_batch_once_and_stops_at_the_end(spark, flows, tmp_path):
    path = str(tmp_path / "sent")
    sent = replay(flows, text_sink(path), 1300, ["id"], batches=5, delay=0)
    assert [tuple(r) for r in sent.orderBy("batch_no").collect()] == [
        (0, 1300, 325),
        (1, 1300, 325),
        (2, 400, 100),
    ]
    lines = spark.read.text(path)
    assert lines.count() == lines.distinct().count() == 3000


def test_replay_goes_on_from_a_batch(spark, flows, tmp_path):
    whole, rest = str(tmp_path / "whole"), str(tmp_path / "rest")
    replay(flows, text_sink(whole), 500, ["id"], batches=3, delay=0, fmt="json")
    for start, stop in ((0, 1), (1, 3)):
        replay(
            flows, text_sink(rest), 500, ["id"], batches=stop, delay=0, fmt="json",
            start_batch=start,
        )
    assert sorted(spark.read.text(rest).collect()) == sorted(spark.read.text(whole).collect())
