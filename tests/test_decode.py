"""Decoding hand-made messages."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import LOG_SCHEMA, ORDER_EVENT, ORDER_EVENT_WITH_METADATA
from millrace.operators import decode_checked, decode_events, encode_events, flatten_metadata, good_events, quarantined

GOOD = (
    '{"order_id":"ORD-1","customer_id":"CUST-1","product_id":"PROD-7","quantity":3,"unit_price":19.99,'
    '"event_time":"2024-01-01T00:02:00.123456+00:00","event_type":"ORDER_CREATED"}'
)
EXPECTED = {
    "good": None,
    "unknown_field": None,
    "zoned": None,
    "text": "malformed_json",
    "list": "malformed_json",
    "wrong_type": "malformed_json",
    "cut": "malformed_json",
    "null_value": "missing_required",
    "empty_object": "missing_required",
    "no_time": "missing_required",
    "null_time": "missing_required",
}
VALUES = {
    "good": GOOD,
    "unknown_field": GOOD.replace('"quantity"', '"colour":"red","quantity"'),
    "zoned": GOOD.replace("00:02:00.123456+00:00", "02:02:00.123456+02:00"),
    "text": "not json",
    "list": "[1]",
    "wrong_type": GOOD.replace('"quantity":3', '"quantity":"zz"'),
    "cut": GOOD[:-20],
    "null_value": None,
    "empty_object": "{}",
    "no_time": GOOD.replace('"event_time":"2024-01-01T00:02:00.123456+00:00",', ""),
    "null_time": GOOD.replace('"2024-01-01T00:02:00.123456+00:00"', "null"),
}


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (key.encode(), None if value is None else value.encode(), "orders", 0, offset, datetime(2024, 1, 1, 0, 3), 0)
        for offset, (key, value) in enumerate(VALUES.items())
    ]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def test_default_schema(log):
    decoded = decode_events(log)
    assert decoded.columns == [*ORDER_EVENT.names, "kafka_timestamp"]
    assert decoded.count() == len(VALUES)


def test_times_are_read_to_the_microsecond_and_with_their_zone(log):
    times = decode_events(log, lineage=True).where(F.col("key").isin("good", "zoned"))
    micros = [row[0] for row in times.select(F.unix_micros("event_time")).collect()]
    assert micros == [1_704_067_320_123_456] * 2


def test_lineage(log):
    row = decode_events(log, lineage=True).where("key = 'list'").first()
    assert (row["topic"], row["partition"], row["offset"]) == ("orders", 0, list(VALUES).index("list"))


def test_every_message_is_good_or_quarantined_with_its_reason(log):
    checked = decode_checked(log).persist()
    assert {row["key"]: row["quarantine_reason"] for row in checked.collect()} == EXPECTED
    good, bad = good_events(checked), quarantined(checked)
    assert {row["key"] for row in good.collect()} == {key for key, reason in EXPECTED.items() if reason is None}
    assert {row["key"]: row["raw_value"] for row in bad.collect()} == {
        key: VALUES[key] for key, reason in EXPECTED.items() if reason
    }
    assert good.count() + bad.count() == log.count()


def test_required_fields_must_exist(log):
    with pytest.raises(ValueError):
        decode_checked(log, ORDER_EVENT, ["order_number"])


def test_event_fields_may_not_hide_columns_of_the_log(log):
    schema = T.StructType([T.StructField("offset", T.LongType())])
    decode_events(log, schema)
    for call in (lambda: decode_events(log, schema, lineage=True), lambda: decode_checked(log, schema, [])):
        with pytest.raises(ValueError):
            call()


def test_metadata(spark):
    value = GOOD[:-1] + (
        ',"status":"PENDING","payment_method":"PAYPAL",'
        '"_metadata":{"producer":"p","is_late":true,"produced_at":"2024-01-01T00:32:00+00:00"}}'
    )
    log = spark.createDataFrame([(None, value.encode(), "orders", 0, 0, datetime(2024, 1, 1), 0)], LOG_SCHEMA)
    row = flatten_metadata(decode_events(log, ORDER_EVENT_WITH_METADATA)).first()
    assert (row["status"], row["payment_method"], row["producer"], row["is_late"]) == ("PENDING", "PAYPAL", "p", True)
    assert row["produced_at"] is not None


def test_encoding_keeps_nulls_and_microseconds(spark):
    df = spark.sql("select 7L as id, timestamp '2024-01-01 00:02:00.123456' as t, cast(null as string) as note")
    row = encode_events(df, "id").first()
    assert (row["key"], row["value"]) == ("7", '{"id":7,"t":"2024-01-01T00:02:00.123456Z","note":null}')
    assert encode_events(df, ["id", "note"]).first()["key"] == '{"id":7,"note":null}'
    assert encode_events(df, None).columns == ["value"]
    assert encode_events(df, "id", ["id"]).first()["value"] == '{"id":7}'
