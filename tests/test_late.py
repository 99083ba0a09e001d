"""Late events on tables: watermarks per batch, both join forms, reprocessing."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import (
    EventWindow,
    aggregate_windows,
    batch_watermarks,
    classify_lateness,
    enrich_late,
    mark_late,
    reprocess,
    reprocess_sessions,
    split_late,
    with_lateness,
)

START = datetime(2024, 1, 1)
SCHEMA = "batch long, event_time timestamp_ntz, k string, q long"


def minute(number):
    return START + timedelta(minutes=number)


@pytest.fixture(scope="module")
def recorded(spark):
    rows = [
        (0, minute(1), "a", 1),
        (0, minute(20), "a", 1),
        (1, minute(21), "a", 1),
        (2, minute(2), "a", 1),
        (2, minute(11), "b", 1),
        (3, None, "b", 1),
        (4, minute(40), "a", 1),
        (5, minute(29), "b", 1),
        (5, minute(30), "b", 1),
        (None, minute(0), "a", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_watermarks_follow_the_batches_before(recorded):
    marks = {row["batch"]: row["watermark"] for row in batch_watermarks(recorded, "batch").collect()}
    assert marks == {0: None, 1: minute(10), 2: minute(11), 3: minute(11), 4: minute(11), 5: minute(30)}


@pytest.mark.parametrize("limit", [None, 0], ids=["broadcast", "shuffle"])
def test_every_event_is_kept_and_marked(recorded, limit):
    marked = mark_late(recorded, "batch", broadcast_rows=limit)
    assert marked.count() == recorded.count()
    on_time, late = split_late(marked)
    assert sorted((row["batch"], row["event_time"]) for row in late.collect()) == [(2, minute(2)), (5, minute(29))]
    assert on_time.count() + late.count() == recorded.count()


def test_watermarks_over_many_batches_equal_a_plain_running_maximum(spark):
    df = spark.range(5_000).select(
        (F.col("id") % 997).alias("batch"),
        F.timestamp_micros(F.abs(F.xxhash64("id")) % 1_000_000_000_000).alias("event_time"),
    )
    expected, high = {}, None
    for row in df.groupBy("batch").agg(F.max("event_time").alias("m")).orderBy("batch").collect():
        expected[row["batch"]] = None if high is None else high - timedelta(minutes=10)
        high = row["m"] if high is None else max(high, row["m"])
    assert {row["batch"]: row["watermark"] for row in batch_watermarks(df, "batch").collect()} == expected


def test_lateness_and_its_class(spark):
    rows = [(minute(0), minute(60)), (minute(0), minute(60) + timedelta(microseconds=1)), (minute(5), minute(4))]
    df = spark.createDataFrame(rows, "event_time timestamp_ntz, kafka_timestamp timestamp_ntz")
    described = classify_lateness(with_lateness(df), "1 hour").collect()
    assert [(r["lateness_seconds"], r["lateness_class"]) for r in described] == [
        (3600, "within_max"),
        (3600, "beyond_max"),
        (-60, "within_max"),
    ]
    metadata = enrich_late(df).select("_late_metadata.*").collect()
    assert {r["reason"] for r in metadata} == {"late_arrival"} and all(r["routed_at"] for r in metadata)


@pytest.mark.parametrize("window", [EventWindow(), EventWindow("sliding", "10 minutes", "3 minutes")], ids=str)
def test_reprocessed_windows_equal_all_events_at_once(recorded, window):
    on_time, late = split_late(mark_late(recorded, "batch"))
    corrected = reprocess(on_time, late, window, group_by=["k"])
    keys = ["window_start", "window_end", "k"]
    before = aggregate_windows(on_time, window, group_by=["k"])
    merged = before.join(corrected, keys, "left_anti").unionByName(corrected)
    whole = aggregate_windows(recorded, window, group_by=["k"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    touched = aggregate_windows(late, window, group_by=["k"]).select(*keys)
    assert sorted(map(tuple, corrected.select(*keys).collect())) == sorted(map(tuple, touched.collect()))


def test_without_late_events_nothing_is_reprocessed(recorded):
    nothing = recorded.where("false")
    assert reprocess(recorded, nothing, EventWindow(), group_by=["k"]).isEmpty()
    new, former = reprocess_sessions(recorded, nothing, EventWindow("session"), group_by=["k"])
    assert new.isEmpty() and former.isEmpty()


def test_reprocessing_is_for_its_kind_of_window(recorded):
    with pytest.raises(ValueError):
        reprocess(recorded, recorded, EventWindow("session"), group_by=["k"])
    with pytest.raises(ValueError):
        reprocess_sessions(recorded, recorded, EventWindow(), group_by=["k"])


def test_a_late_event_joins_two_long_sessions_beyond_the_first_look_back(spark):
    gap = EventWindow("session", gap="5 minutes")
    chain = [m for m in range(0, 400, 5) if m != 200]
    on_time = spark.createDataFrame([(0, minute(m), "a", 1) for m in chain] + [(0, minute(200), "b", 1)], SCHEMA)
    late = spark.createDataFrame([(1, minute(200), "a", 1)], SCHEMA)
    new, former = reprocess_sessions(on_time, late, gap, group_by=["k"], lookback="6 minutes")
    assert [tuple(r) for r in new.collect()] == [(minute(0), minute(400), "a", 80)]
    assert sorted(tuple(r) for r in former.collect()) == [
        (minute(0), minute(200), "a"),
        (minute(205), minute(400), "a"),
    ]


def test_corrected_sessions_equal_all_events_at_once(spark):
    df = spark.range(3_000).select(
        (F.abs(F.xxhash64("id")) % 5).cast("string").alias("k"),
        F.timestamp_micros(F.abs(F.xxhash64("id", F.lit(7))) % 1_000_000_000_000).alias("event_time"),
        (F.col("id") % 50 == 0).alias("is_late"),
    )
    window, keys = EventWindow("session", gap="20 minutes"), ["window_start", "window_end", "k"]
    on_time, late = split_late(df)
    new, former = reprocess_sessions(on_time, late, window, group_by=["k"], lookback="1 hour")
    before = aggregate_windows(on_time, window, group_by=["k"])
    after = before.join(former, keys, "left_anti").join(new, keys, "left_anti").unionByName(new)
    whole = aggregate_windows(df, window, group_by=["k"])
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, whole.collect()))
