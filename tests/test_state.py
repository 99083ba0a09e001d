"""Open windows from the state of streams."""

import pytest
from streams import EVENT, GOLDEN, Feed, golden, rows

from millrace.operators import EventWindow, aggregate_windows, deduplicate, with_event_watermark
from millrace.plans.pipeline import EventPipeline
from millrace.streaming import AVAILABLE_NOW, open_windows, parquet_sink, run

SPEC = {
    "n": "count(*)", "same": "count(*)", "total": "sum(q)", "mean": "avg(q)", "first": "min(event_time)", "last": "max(k)",
    "cents": "sum(p)", "cent": "avg(p)", "none": "sum(z)", "nones": "avg(z)", "known": "count(z)",
}


def priced(df):
    return df.selectExpr("*", "cast(q as decimal(12,2)) p", "cast(null as int) z")


def collected(df, columns):
    return sorted(map(repr, (tuple(row) for row in df.select(*columns).collect())))


@pytest.mark.parametrize("provider", ["RocksDBStateStoreProvider", "HDFSBackedStateStoreProvider"])
@pytest.mark.parametrize(
    "window",
    [EventWindow("tumbling", "7 minutes"), EventWindow("sliding", "10 minutes", "3 minutes"), EventWindow("session", gap="5 minutes")],
    ids=str,
)
def test_closed_and_open_windows_are_all_windows(spark, folder, window, provider):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", f"org.apache.spark.sql.execution.streaming.state.{provider}")
    try:
        feed, end = Feed(spark, f"{folder}/in"), 0
        for batch in (GOLDEN[0], GOLDEN[2], GOLDEN[3], GOLDEN[5]):
            feed.add(rows(batch))
            stream = priced(with_event_watermark(feed.stream(), delay="25 minutes"))
            result = aggregate_windows(stream, window, group_by=["k"], aggregations=SPEC)
            run(parquet_sink(result, f"{folder}/out", f"{folder}/c", partition_by=None), AVAILABLE_NOW).awaitTermination()
            events = priced(feed.table())
            whole = aggregate_windows(events, window, group_by=["k"], aggregations=SPEC)
            still = open_windows(spark, f"{folder}/c", events, window, group_by=["k"], aggregations=SPEC)
            assert still.dtypes == whole.dtypes
            closed = spark.read.schema(whole.schema).parquet(f"{folder}/out")
            assert collected(closed.unionByName(still), whole.columns) == collected(whole, whole.columns)
            end += closed.count()
        assert end and still.count()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_open_windows_beside_other_state_and_of_an_earlier_batch(spark, folder):
    feed = Feed(spark, f"{folder}/in")
    for batch in (["01:00 a", "02:00 b"], ["03:00 a", "03:00 a"]):
        feed.add(rows(batch))
        unique = deduplicate(with_event_watermark(feed.stream(), delay="1 hour"), ["event_time", "k"])
        result = aggregate_windows(unique, EventWindow(), group_by=["k"])
        run(parquet_sink(result, f"{folder}/out", f"{folder}/c", partition_by=None), AVAILABLE_NOW).awaitTermination()
    read = lambda **at: {(r["k"], r["event_count"]) for r in open_windows(spark, f"{folder}/c", feed.table(), EventWindow(), group_by=["k"], **at).collect()}
    assert read() == {("a", 2), ("b", 1)}
    assert read(batch_id=0) == {("a", 1), ("b", 1)}
    with pytest.raises(ValueError, match="other measures"):
        open_windows(spark, f"{folder}/c", feed.table(), EventWindow(), group_by=["k"], aggregations={"s": "sum(q)", "n": "count(*)"})


def test_streams_without_windows_have_none_open(spark, folder):
    feed = golden(spark, f"{folder}/in")
    unique = deduplicate(with_event_watermark(feed.stream()), ["k", "event_time"])
    run(parquet_sink(unique, f"{folder}/out", f"{folder}/c", time_column="event_time"), AVAILABLE_NOW).awaitTermination()
    with pytest.raises(ValueError, match="0 operators"):
        open_windows(spark, f"{folder}/c", feed.table(), EventWindow())


def test_corrections_of_a_running_pipeline(spark, folder):
    """A later value of the stream replaces a correction; the next correction has both kinds of events."""
    source = Feed(spark, f"{folder}/in")
    config = {
        "source": {"type": "events"},
        "watermark": {"max_ahead": None},
        "processing": {"window_type": "tumbling", "window_duration": "1 hour", "group_by": ["k"], "aggregations": {"n": "count(*)"}},
        "late": {"path": f"{folder}/routed"},
        "output": {"type": "table", "path": f"{folder}/table"},
        "checkpoint": f"{folder}/c",
        "trigger": AVAILABLE_NOW,
    }
    pipeline = EventPipeline(config)

    def feed(*texts):
        source.add(rows(list(texts)))
        pipeline.start(spark, source.stream())
        pipeline.await_all(120)

    def value():
        return {row["k"]: row["n"] for row in pipeline.upserted().read(spark).where("window_start = '2024-01-01 00:00:00'").collect()}

    feed("01:00 a", "50:00 a", "50:30 b")
    feed("02:00 a", "51:00 b")
    assert value() == {"a": 2, "b": 2}
    pipeline.correct(spark, EVENT)
    assert value() == {"a": 3, "b": 2}
    feed("52:00 a", "53:00 a", "54:00 a")
    assert value() == {"a": 5, "b": 2}
    for _ in range(2):
        pipeline.correct(spark, EVENT)
        assert value() == {"a": 6, "b": 2}
    still = {(row["k"], row["n"]) for row in pipeline.open_windows(spark, source.table()).collect()}
    assert ("a", 5) in still
    with pytest.raises(ValueError, match="behind the late router"):
        EventPipeline({**config, "late": None}).correct(spark, EVENT)
