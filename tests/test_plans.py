"""Physical plans: what is read, shuffled and computed how often."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from millrace.operators import (
    EventWindow,
    aggregate_windows,
    decode_changes,
    decode_checked,
    deduplicate,
    good_events,
    latest_state,
    mark_late,
    reprocess,
    split_late,
)
from millrace.operators.broadcasts import may_match, semi_join
from millrace.plans.registry import REGISTRY
from millrace.plans.window_queries import orders
from millrace.sources.tables import ACCOUNT_ROW, change_log, events, order_events, spoiled_log

SF_DIR = "/root/testdata/sf0.001"
RUN_STREAMS = {
    "cdc_apply_stream",
    "cdc_latest_state_dirty",
    "late_router_backlog",
    "late_sessions_complete",
    "sink_upsert_restart",
    "stream_late_dropped",
    "closed_windows",
    "dedup_stream",
    "late_router",
    "late_router_complete",
    "log_scan",
    "rolling_avg_stream",
    "sink_parquet_roundtrip",
    "sink_upsert_final",
}


@pytest.fixture(autouse=True)
def whole_plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    spark.conf.set("spark.sql.maxPlanStringLength", "1000000")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - RUN_STREAMS))
def test_no_python_and_no_pairing_of_all_rows(spark, name):
    text = plan(REGISTRY[name].run(spark, SF_DIR))
    for operator in ("Python", "Pandas", "Cartesian", "NestedLoop", "GlobalLimit"):
        assert operator not in text


def test_only_the_columns_of_the_aggregate_are_read(spark):
    text = plan(aggregate_windows(orders(spark, SF_DIR), EventWindow(), group_by=["event_type"]))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in text
    assert "PushedFilters: [IsNotNull(ts)]" in text


@pytest.mark.parametrize(
    ("window", "shuffles"),
    [
        (EventWindow(), 1),
        (EventWindow("sliding", "1 hour", "15 minutes"), 2),
        (EventWindow("sliding", "1 hour", "1 minute"), 3),
        (EventWindow("session", gap="30 minutes"), 2),
    ],
    ids=str,
)
def test_rows_are_combined_before_the_first_shuffle(spark, window, shuffles):
    text = plan(aggregate_windows(orders(spark, SF_DIR), window, group_by=["customer_id"]))
    assert text.count("Exchange hashpartitioning") == shuffles
    below_last_exchange = text.rsplit("Exchange hashpartitioning", 1)[1]
    assert "partial_count" in below_last_exchange and "Expand" not in text


def test_duplicates_and_changes_are_combined_before_the_shuffle(spark):
    source = order_events(events(spark, SF_DIR))
    changes = decode_changes(change_log(spark, SF_DIR), ACCOUNT_ROW)
    for df, partial in (
        (deduplicate(source, ["order_id"], first_by=["kafka_timestamp"]), "partial_min_by"),
        (latest_state(changes), "partial_max_by"),
    ):
        text = plan(df)
        assert text.count("Exchange") == 1 and partial in text.split("Exchange")[1]


def test_a_message_is_parsed_once_whatever_is_asked_of_its_fields(spark):
    log = spoiled_log(events(spark, SF_DIR)).select("key", "value", "topic", "partition", "offset", "timestamp")
    stored = log.checkpoint()
    assert plan(good_events(decode_checked(stored)).where("quantity > 5 and customer_id <> ''")).count("from_json") == 1


def test_reprocessing_reads_only_the_days_of_the_late_events(spark, folder):
    """A very old late event adds its own day, not all days since."""
    dated = orders(spark, SF_DIR).withColumn("utc_date", F.col("event_time").cast("date"))
    dated.write.partitionBy("utc_date").parquet(f"{folder}/on_time")
    on_time = spark.read.parquet(f"{folder}/on_time")
    chosen = "date'2024-01-20'", "date'2024-01-02'"
    late = on_time.where(f"utc_date in ({', '.join(chosen)}) and hour(event_time) between 3 and 20").limit(400)
    late = late.unionByName(on_time.where("utc_date = date'2024-01-02' and hour(event_time) between 3 and 20").limit(1))
    window = EventWindow("tumbling", "1 hour")
    result = reprocess(on_time, late, window, group_by=["event_type"])
    text = plan(result)
    filters = text.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "utc_date" in filters and "2024-01-20" in filters and "2024-01-02" in filters and "2024-01-10" not in filters
    assert "GreaterThanOrEqual(event_time,2024-01-20T00:00" in text
    # The join comes before the aggregate, and the touched windows are broadcast as they were counted.
    assert text.index("HashAggregate") < text.index("BroadcastHashJoin") and "SortMergeJoin" not in text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        beyond = plan(reprocess(on_time, late, window, group_by=["event_type"], broadcast_rows=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Beyond the bound the touched windows are shuffled; what is broadcast is their Bloom filter.
    assert "SortMergeJoin" in beyond and beyond.count("BroadcastExchange") == 1 and "bit_or" in beyond


def test_large_lookups_are_filtered_below_the_shuffle(spark):
    """Beyond the broadcast bound, rows that can't match don't reach the exchange."""
    df = spark.range(20_000).selectExpr("if(id % 50 = 0, null, id) k", "cast(id % 7 as string) g", "id v")
    lookup = spark.range(0, 20_000, 40).selectExpr("if(id % 80 = 0, id, null) the_k", "cast(id % 7 as string) the_g").distinct()
    on, rows = {"k": "the_k", "g": "the_g"}, lookup.count()
    joined = semi_join(df, lookup, on, rows=rows, limit=10)
    assert joined.columns == df.columns
    wanted = semi_join(df, lookup, on, rows=rows)
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, wanted.collect()))
    passed = may_match(df, lookup, on, rows).count()
    assert wanted.count() <= passed < 0.2 * 20_000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(semi_join(df, lookup, on, rows=10**9, limit=10).select("v"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = text.index("LeftSemi")
    assert "Exchange hashpartitioning" in text[join:] and "BroadcastHashJoin" in text[text.index("Exchange hashpartitioning", join) :]


def test_watermarks_are_broadcast_only_when_counted_small(spark):
    source = orders(spark, SF_DIR).selectExpr("*", "date_trunc('hour', kafka_timestamp) as batch")
    assert "BroadcastHashJoin" in plan(mark_late(source, "batch"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        beyond = plan(mark_late(source, "batch", broadcast_rows=10))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Beyond the bound the touched windows are shuffled; what is broadcast is their Bloom filter.
    assert "SortMergeJoin" in beyond and beyond.count("BroadcastExchange") == 1 and "bit_or" in beyond


def test_both_sides_of_the_split_cover_the_source(spark):
    source = orders(spark, SF_DIR).selectExpr("*", "date_trunc('hour', kafka_timestamp) as batch")
    on_time, late = split_late(mark_late(source, "batch"))
    assert on_time.count() + late.count() == source.count() and late.count() > 0
