"""Sessions of a stream that take late events, against the table of all events so far."""

import random

import pytest
from pyspark.sql import functions as F
from streams import EVENT, Feed, at, rows

from millrace.operators import EventWindow, aggregate_windows
from millrace.plans.config import PipelineConfig
from millrace.plans.late_queries import weekly
from millrace.plans.pipeline import query_settings, session_settings
from millrace.streaming import AVAILABLE_NOW, UpsertTable, apply_session_changes, run, session_changes, table_sink

SPEC = {
    "n": "count(*)", "q_n": "count(q)", "total": "sum(q)", "cents": "sum(p)", "mean": "avg(q)", "cent": "avg(p)", "lo": "min(q)", "hi": "max(d)",
}
KEYS = ["window_start", "window_end", "k"]
SETTINGS = session_settings(PipelineConfig.from_dict({"source": {"type": "events"}, "shuffle_partitions": 2}))


def measured(df):
    return df.selectExpr("event_time", "k", "nullif(q, 3) q", "cast(q / 4 as decimal(12,2)) p", "cast(q as double) d")


def take(spark, folder, feed, table, gap="5 minutes", **settings):
    changed = session_changes(measured(feed.stream()), gap, group_by=["k"], aggregations=SPEC, **settings)
    with query_settings(spark, SETTINGS):
        query = run(table_sink(changed, apply_session_changes(table), "update", f"{folder}/c"), AVAILABLE_NOW)
    query.awaitTermination(180)
    assert query.exception() is None


def collected(df, columns):
    return sorted(map(repr, (tuple(row) for row in df.select(*columns).collect())))


def same_as_table(spark, feed, table, gap="5 minutes"):
    whole = aggregate_windows(measured(feed.table()), EventWindow("session", gap=gap), group_by=["k"], aggregations=SPEC)
    assert table.read(spark).select(*whole.columns).dtypes == whole.dtypes
    assert collected(table.read(spark), whole.columns) == collected(whole, whole.columns)


def test_late_events_lengthen_and_join_sessions(spark, folder):
    feed, table = Feed(spark, f"{folder}/in"), UpsertTable(f"{folder}/t", KEYS)
    for batch in (
        ["01:00 a", "20:00 a", "30:00 b"],
        ["25:01 a"],
        ["22:30 a", "35:00 b"],  # joins two of a; b exactly a gap on
        ["10:00 a", "05:30 a", "40:01 b"],  # a chain back to the first one is open by a second
        ["15:00 a", "02:00 c"],  # the chain closes: one session of a
        ["01:00 a", "00:59 a"],  # the same event once more, and one before
    ):
        feed.add(rows(batch))
        take(spark, folder, feed, table)
        same_as_table(spark, feed, table)
    assert table.read(spark).where("k = 'a'").count() == 1


def test_random_arrivals_by_table(spark, folder):
    chosen, feed, table = random.Random(6), Feed(spark, f"{folder}/in"), UpsertTable(f"{folder}/t", KEYS)
    for _ in range(4):
        batch = [(at(f"{chosen.randrange(600)}:{chosen.randrange(60)}"), chosen.choice(["a", "b", "c", None]), chosen.randrange(6), at("50:00")) for _ in range(150)]
        feed.add([*batch, (None, "a", 1, at("50:00"))])
        take(spark, folder, feed, table)
        same_as_table(spark, feed, table)


def test_events_beyond_the_horizon_are_told(spark, folder):
    feed, table = Feed(spark, f"{folder}/in"), UpsertTable(f"{folder}/t", KEYS)
    for batch in (["01:00 a", "30:00 a"], ["200:00 a", "10:00 b"], ["02:00 a", "139:59 a", "140:00 a", "11:00 b"]):
        feed.add(rows(batch))
        take(spark, folder, feed, table, horizon="1 hour")
    starts = sorted((row["k"], (row["window_start"] - at("00:00").replace(tzinfo=None)).total_seconds() / 60, row["n"]) for row in table.read(spark).collect())
    assert starts == [("a", 1, 1), ("a", 30, 1), ("a", 140, 1), ("a", 200, 1), ("b", 10, 2)]
    late = spark.read.parquet(f"{folder}/t/too_late").collect()
    assert sorted(row["window_start"].minute for row in late) == [2, 19] and all(row["window_start"] == row["window_end"] for row in late)


def test_sessions_of_streams_need_keys(spark, folder):
    with pytest.raises(ValueError, match="group_by"):
        session_changes(Feed(spark, folder, EVENT).stream(), "5 minutes", group_by=[])


def test_state_of_a_key_is_one_value(spark, folder):
    """However many sessions a key has, they are read and written at once; and one file of events feeds many tasks."""
    feed, table = Feed(spark, f"{folder}/in"), UpsertTable(f"{folder}/t", KEYS)
    for batch in ([f"{minute}:00 a" for minute in range(0, 600, 10)], ["05:00 a", "300:30 a"]):
        feed.add(rows(batch))
        take(spark, folder, feed, table)
        same_as_table(spark, feed, table)
    held = spark.read.format("statestore").option("stateVarName", "sessions").load(f"{folder}/c").collect()
    assert [len(row["value"]["sessions"]) for row in held] == [59]


def test_large_tables_feed_streams_by_many_tasks(spark, folder):
    made = spark.range(0, 500_000, 1, 1).selectExpr(
        "id event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) ts", "id % 9 user_id", "'view' event_type", "1.0D value", """'{"k":1}' props"""
    )
    made.write.parquet(f"{folder}/events.parquet")
    fed = weekly(spark, folder)
    counts = [row["n"] for row in fed.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 3 and sum(counts) == 500_000 and max(counts) < 250_000
