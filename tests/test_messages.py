import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from conftest import plan_of
from flowscore.functions.payloads import build_payload, parse_payload
from flowscore.operators.messages import (
    decode_messages,
    encode_messages,
    keep_complete,
    rejected_rows,
)

SCHEMA = StructType(
    [
        StructField("a", IntegerType(), False),
        StructField("b", StringType()),
        StructField("c", DoubleType(), False),
    ]
)

CASES = [
    ("csv", "1,x,2.5", (1, "x", 2.5), True),
    ("csv", "1,2.5", (1, "2.5", None), False),
    ("csv", "bad,x,1.0", (None, "x", 1.0), False),
    ("csv", "", (None, None, None), False),
    ("csv", "1,x,2.5,extra", (1, "x", 2.5), True),
    ("json", '{"a":1,"b":"x","c":2.5}', (1, "x", 2.5), True),
    ("json", '{"a":1}', (1, None, None), False),
    ("json", "nope", (None, None, None), False),
    ("json", '{"a":"z","c":1}', (None, None, 1.0), False),
]


def messages(spark, values):
    rows = [(value.encode(), 0, n, None) for n, value in enumerate(values)]
    return spark.createDataFrame(
        rows, "value BINARY, partition INT, offset BIGINT, timestamp TIMESTAMP"
    )


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_decode_matrix(spark, fmt):
    cases = [case for case in CASES if case[0] == fmt]
    decoded = decode_messages(messages(spark, [c[1] for c in cases]), SCHEMA, fmt)
    got = {r["_meta"]["offset"]: (r.a, r.b, r.c) for r in decoded.collect()}
    assert got == {n: case[2] for n, case in enumerate(cases)}
    kept = {r["_meta"]["offset"] for r in keep_complete(decoded, SCHEMA).collect()}
    assert kept == {n for n, case in enumerate(cases) if case[3]}
    lost = {r["_meta"]["offset"] for r in rejected_rows(decoded, SCHEMA).collect()}
    assert lost == set(got) - kept


def test_encode_keeps_nulls_in_place_and_quotes(spark):
    df = spark.createDataFrame([(1, None, 2.5), (2, "q,z", 3.0)], SCHEMA)
    csv = sorted(r.value for r in encode_messages(df, "csv").collect())
    assert csv == ["1,,2.5", '2,"q,z",3.0']
    json = sorted(r.value for r in encode_messages(df, "json").collect())
    assert json == ['{"a":1,"c":2.5}', '{"a":2,"b":"q,z","c":3.0}']


text = st.text(st.characters(min_codepoint=1, max_codepoint=0x2FF)) | st.text(' ",\\\n\r\t\'x')


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(
        st.tuples(
            st.integers(-(2**31), 2**31 - 1),
            st.one_of(st.none(), text),
            st.floats(allow_nan=False, allow_infinity=False),
        ),
        min_size=1,
        max_size=20,
    ),
    fmt=st.sampled_from(["csv", "json"]),
)
def test_encode_then_decode_is_identity(spark, rows, fmt):
    df = spark.createDataFrame(rows, SCHEMA)
    back = keep_complete(decode_messages(encode_messages(df, fmt), SCHEMA, fmt), SCHEMA)
    order = lambda r: (r[0], r[1] is None, r[1] or "", r[2])
    assert sorted((tuple(r) for r in back.collect()), key=order) == sorted(rows, key=order)


def test_no_required_field_means_no_filter(spark):
    schema = StructType([StructField("a", IntegerType())])
    decoded = decode_messages(messages(spark, ["1", "bad"]), schema)
    assert keep_complete(decoded, schema).count() == 2
    assert rejected_rows(decoded, schema).count() == 0


def test_fields_named_like_metadata_do_not_clash(spark):
    schema = StructType([StructField("offset", IntegerType(), False), StructField("x.y", StringType())])
    decoded = decode_messages(messages(spark, ["7,v"]), schema)
    row = keep_complete(decoded, schema).select("offset", "`x.y`", "_meta.offset").first()
    assert tuple(row) == (7, "v", 0)
    with pytest.raises(ValueError, match="meta"):
        decode_messages(messages(spark, ["1"]), schema, meta="offset")


def test_unknown_format_raises(spark):
    df = messages(spark, ["1"])
    with pytest.raises(ValueError, match="avro"):
        decode_messages(df, SCHEMA, "avro")
    with pytest.raises(ValueError, match="avro"):
        encode_messages(df, "avro")


def test_messages_without_metadata(spark):
    only_value = messages(spark, ["1,x,2.5"]).select("value")
    assert decode_messages(only_value, SCHEMA).columns == ["a", "b", "c"]


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_message_without_payload_is_a_record_without_fields(spark, fmt):
    empty = spark.createDataFrame([(None, 0, 5, None)], messages(spark, ["x"]).schema)
    decoded = decode_messages(empty, SCHEMA, fmt)
    row = decoded.first()
    assert (row.a, row.b, row.c, row["_meta"]["offset"]) == (None, None, None, 5)
    assert rejected_rows(decoded, SCHEMA).count() == 1


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_a_payload_is_parsed_once(spark, fmt):
    decoded = decode_messages(messages(spark, ["1,x,2.5"]), SCHEMA, fmt)
    assert plan_of(keep_complete(decoded, SCHEMA).filter("a > 0")).count(f"from_{fmt}(") == 1


def test_decode_and_check_never_shuffle_or_leave_the_jvm(spark):
    decoded = decode_messages(messages(spark, ["1,x,2.5"]).repartition(2), SCHEMA)
    plan = plan_of(keep_complete(decoded, SCHEMA).filter(F.col("a") > 0))
    assert plan.count("Exchange") == 1  # the repartition above
    assert "Python" not in plan


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_microseconds_and_empty_texts_come_back(spark, fmt):
    rows = spark.sql(
        "SELECT 1 AS id, TIMESTAMP_NTZ '2024-01-02 03:04:05.123456' AS ts, "
        "TIMESTAMP '2024-01-02 03:04:05.654321' AS at, '' AS text, CAST(NULL AS STRING) AS gone"
    )
    text = build_payload(rows.columns, fmt)
    back = rows.select(parse_payload(text, rows.schema, fmt).alias("r")).select("r.*")
    assert back.collect() == rows.collect()
