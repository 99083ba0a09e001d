"""Streams: golden output, stream = table, sinks, duplicates, restarts."""

import pytest
from streams import GOLDEN, Feed, at, golden, rows

from millrace.operators import EventWindow, aggregate_windows, deduplicate, with_event_watermark, with_late_metadata
from millrace.streaming import (
    AVAILABLE_NOW,
    UpsertTable,
    console_sink,
    output_mode,
    parquet_sink,
    run,
    table_sink,
    triggered,
    write_late_events,
)
from millrace.streaming.upsert import merge_corrections, merge_into

SPEC = {"n": "count(*)", "total": "sum(q)", "mean": "avg(q)", "first": "min(event_time)"}
LONG = "2 days"


def finished(query):
    query.awaitTermination(180)
    assert query.exception() is None
    return query


def window_key(row):
    return (row["window_start"].minute, row["k"], row["event_count"])


def test_golden_windows_in_append_mode(spark, folder):
    feed = golden(spark, f"{folder}/in")
    result = aggregate_windows(with_event_watermark(feed.stream()), EventWindow(), group_by=["k"])
    query = finished(run(parquet_sink(result, f"{folder}/out", f"{folder}/c"), AVAILABLE_NOW))
    written = spark.read.parquet(f"{folder}/out")
    assert sorted(map(window_key, written.collect())) == [(0, "a", 1), (10, "a", 1), (20, "a", 2)]
    assert {str(row["event_date"]) for row in written.collect()} == {"2024-01-01"}
    dropped = [op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]]
    assert sum(dropped) == 4


@pytest.mark.parametrize(
    "window",
    [
        EventWindow("tumbling", "7 minutes"),
        EventWindow("sliding", "10 minutes", "3 minutes"),
        EventWindow("session", gap="5 minutes"),
    ],
    ids=str,
)
def test_a_stream_gives_the_windows_of_the_table(spark, folder, window):
    feed = golden(spark, f"{folder}/in")
    feed.add([(at("2000:00"), "end", 1, at("2000:00"))])
    stream = with_event_watermark(feed.stream(2), delay="1 day")
    result = aggregate_windows(stream, window, group_by=["k"], aggregations=SPEC)
    finished(run(parquet_sink(result, f"{folder}/out", f"{folder}/c", partition_by=None), AVAILABLE_NOW))
    whole = aggregate_windows(feed.table(), window, group_by=["k"], aggregations=SPEC).where("k <> 'end'")
    written = spark.read.parquet(f"{folder}/out").select(*whole.columns)
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("slide", ["1 minute", "3 minutes", "4 minutes"])
def test_panes_of_a_stream_give_the_windows_of_the_table(spark, folder, slide):
    feed, window = golden(spark, f"{folder}/in"), EventWindow("sliding", "10 minutes", slide)
    feed.add([(at("4000:00"), "end", 1, at("4000:00"))])
    feed.add([(at("8000:00"), "end", 1, at("8000:00"))])
    stream = with_event_watermark(feed.stream(2), delay="1 day")
    result = aggregate_windows(stream, window, group_by=["k"], aggregations=SPEC, stream_panes=True)
    finished(run(parquet_sink(result, f"{folder}/out", f"{folder}/c", partition_by=None), AVAILABLE_NOW))
    whole = aggregate_windows(feed.table(), window, group_by=["k"], aggregations=SPEC).where("k <> 'end'")
    written = spark.read.parquet(f"{folder}/out").where("k <> 'end'").select(*whole.columns)
    assert written.dtypes == whole.dtypes
    assert sorted(map(tuple, written.collect())) == sorted(map(tuple, whole.collect()))


def test_upserted_windows_are_final_and_survive_restarts(spark, folder):
    feed, table = Feed(spark, f"{folder}/in"), UpsertTable(f"{folder}/t", ["window_start", "window_end", "k"])
    for batch in GOLDEN:
        feed.add(rows(batch))
        stream = with_event_watermark(feed.stream(), delay=LONG)
        result = aggregate_windows(stream, EventWindow(), group_by=["k"])
        mode = output_mode("tumbling", "table")
        finished(run(table_sink(result, table.upsert_batch, mode, f"{folder}/c"), AVAILABLE_NOW))
    whole = aggregate_windows(feed.table(), EventWindow(), group_by=["k"])
    assert sorted(map(tuple, table.read(spark).select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_a_repeated_upsert_changes_nothing(spark, folder):
    table = UpsertTable(folder, ["k"])
    old = spark.sql("select 'a' as k, 1 as v union all select cast(null as string), 5")
    new = spark.sql("select 'a' as k, 2 as v union all select 'b', 3")
    for batch, number in ((old, 0), (old, 0), (new, 1), (new, 1), (old.where("false"), 2)):
        table.upsert_batch(batch, number)
    assert sorted(map(str, table.read(spark).collect())) == ["Row(k='a', v=2)", "Row(k='b', v=3)", "Row(k=None, v=5)"]


def test_a_new_checkpoint_over_one_table_loses_nothing(spark, folder):
    table, expected = UpsertTable(f"{folder}/t", ["k"]), {}
    for number, batch in enumerate((["01:00 a", "02:00 b", "03:00 c"], ["11:00 d", "12:00 e", "13:00 a"])):
        feed = Feed(spark, f"{folder}/in{number}")
        feed.add(rows(batch))
        for _ in range(2):
            writer = table_sink(feed.stream(), table.upsert_batch, "append", f"{folder}/c{number}")
            finished(run(writer, AVAILABLE_NOW))
        expected |= {row[1]: row[0].replace(tzinfo=None) for row in rows(batch)}
        assert {r["k"]: r["event_time"] for r in table.read(spark).collect()} == expected
    late = Feed(spark, f"{folder}/in0")
    late.added = 1
    late.add(rows(["04:00 a", "05:00 f"]))
    finished(run(table_sink(late.stream(), table.upsert_batch, "append", f"{folder}/c0"), AVAILABLE_NOW))
    expected["f"] = at("05:00").replace(tzinfo=None)
    assert {r["k"]: r["event_time"] for r in table.read(spark).collect()} == expected


def versions(spark, *rows):
    return spark.createDataFrame(list(rows), "k string, v int, seen bigint")


def test_what_has_seen_more_of_the_log_is_newer(spark, folder):
    table, read = UpsertTable(folder, ["k"], seen="seen"), lambda: {tuple(r) for r in table.read(spark).collect()}
    table.upsert_batch(versions(spark, ("a", 1, 0), ("b", 1, 0), ("c", 1, 0)), 0)
    table.apply_corrections(versions(spark, ("a", 10, 3), ("d", 10, 2)), versions(spark, ("b", 0, 0)))
    assert read() == {("a", 10), ("c", 1), ("d", 10)}
    # As much as the correction has seen is not more.
    table.upsert_batch(versions(spark, ("a", 2, 3), ("b", 2, 3), ("c", 2, 3)), 1)
    assert read() == {("a", 10), ("c", 2), ("d", 10)}
    table.upsert_batch(versions(spark, ("a", 5, 4), ("b", 5, 4), ("d", 5, 1)), 2)
    assert read() == {("a", 5), ("b", 5), ("c", 2), ("d", 10)}
    for value in (20, 21):
        table.apply_corrections(versions(spark, ("a", value, 4), ("e", value, 4)), versions(spark, ("c", 0, 0)))
        assert read() == {("a", value), ("b", 5), ("d", 10), ("e", value)}
    table.upsert_batch(versions(spark, ("a", 5, 4), ("b", 5, 4), ("d", 5, 1)), 2)
    assert ("a", 21) in read()


def test_corrections_need_what_they_have_seen(spark, folder):
    rows = versions(spark, ("a", 1, 0))
    with pytest.raises(ValueError, match="how much of the log"):
        UpsertTable(folder, ["k"]).apply_corrections(rows)
    with pytest.raises(ValueError, match="how much of the log"):
        UpsertTable(folder, ["k"], seen="upto").apply_corrections(rows)


def test_upserts_need_keys_and_something_to_read(spark, folder):
    with pytest.raises(ValueError):
        UpsertTable(folder, [])
    with pytest.raises(ValueError, match="nothing was written"):
        UpsertTable(folder, ["k"]).read(spark)


class Merging:
    """Stands for a table that takes MERGE: keeps the clauses, as text."""

    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        def call(*arguments):
            texts = [{k: str(v) for k, v in x.items()} if isinstance(x, dict) else str(x) for x in arguments]
            self.calls.append((name, *texts))
            return self

        return call


def test_clauses_of_a_merge(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    merged = Merging()
    monkeypatch.setattr(DataFrame, "mergeInto", lambda self, table, on: merged.into(table, on))
    merge_into("t", ["k"])(versions(spark, ("a", 1, 0)), 0)
    assert [call[0] for call in merged.calls] == ["into", "whenMatched", "updateAll", "whenNotMatched", "insertAll", "merge"]
    merged.calls.clear()
    merge_corrections("t", ["k"], "seen", versions(spark, ("a", 1, 7)), versions(spark, ("b", 0, 0)))
    assert [call[0] for call in merged.calls] == ["into", "whenMatched", "delete", "whenMatched", "update", "whenNotMatched", "insert", "merge"]
    assert "__deleted" in merged.calls[1][1] and "seen" in merged.calls[1][1] and "seen" in merged.calls[3][1]
    assert set(merged.calls[4][1]) == {"k", "v", "seen"} == set(merged.calls[6][1])
    with pytest.raises(ValueError):
        merge_into("t", [])


def test_duplicates_within_the_watermark_are_removed(spark, folder):
    feed = Feed(spark, f"{folder}/in")
    for batch in (["01:00 a", "01:00 a", "02:00 b"], ["01:00 a", "03:00 c"], ["02:00 b", "04:00 d"]):
        feed.add(rows(batch))
    unique = deduplicate(with_event_watermark(feed.stream()), ["k"])
    finished(run(parquet_sink(unique, f"{folder}/out", f"{folder}/c", time_column="event_time"), AVAILABLE_NOW))
    assert sorted(row["k"] for row in spark.read.parquet(f"{folder}/out").collect()) == ["a", "b", "c", "d"]


def test_duplicates_of_a_table(spark):
    df = spark.sql("select * from values ('a', 3, 'x'), ('a', 1, 'y'), ('a', 2, 'z'), ('b', 1, 'w') as t(k, at, v)")
    kept = deduplicate(df, ["k"], first_by=["at"])
    assert kept.columns == ["k", "at", "v"]
    assert sorted(tuple(r) for r in kept.collect()) == [("a", 1, "y"), ("b", 1, "w")]
    assert deduplicate(df.select("k"), ["k"]).count() == 2


def test_side_output_of_events_known_to_be_late(spark, folder):
    feed = Feed(spark, f"{folder}/in")
    feed.add(rows(GOLDEN[2]))
    with pytest.raises(ValueError):
        write_late_events(feed.stream(), f"{folder}/late", f"{folder}/late/_checkpoint")
    finished(write_late_events(feed.stream(), f"{folder}/late", f"{folder}/c", trigger=AVAILABLE_NOW))
    feed.add(rows(GOLDEN[5]))
    finished(write_late_events(feed.stream(), f"{folder}/late", f"{folder}/c", trigger=AVAILABLE_NOW))
    written = spark.read.parquet(f"{folder}/late")
    assert written.count() == 7
    assert {row["_late_metadata"]["reason"] for row in written.collect()} == {"late_arrival"}


def test_reason_of_a_late_event(spark):
    assert with_late_metadata(spark.range(1), reason="replay").first()["_late_metadata"]["reason"] == "replay"


def test_console(spark, folder):
    feed = Feed(spark, f"{folder}/in")
    feed.add(rows(["01:00 a"]))
    result = aggregate_windows(with_event_watermark(feed.stream()), EventWindow(), group_by=["k"])
    query = finished(run(console_sink(result, output_mode("tumbling", "console"), f"{folder}/c"), AVAILABLE_NOW))
    assert sum(progress["numInputRows"] for progress in query.recentProgress) == 1


@pytest.mark.parametrize(
    ("kind", "modes"),
    [
        ("none", ["append", "append", "append", "append"]),
        ("tumbling", ["update", "append", "update", "update"]),
        ("sliding", ["update", "append", "update", "update"]),
        ("session", ["append", "append", "append", "append"]),
    ],
)
def test_output_modes(kind, modes):
    assert [output_mode(kind, sink) for sink in ("console", "parquet", "kafka", "table")] == modes
    assert output_mode(kind, "table", deduplicated=True) == "append"


def test_wrong_sinks_and_triggers_are_refused(spark, folder):
    feed = Feed(spark, folder)
    with pytest.raises(ValueError):
        output_mode("tumbling", "iceberk")
    with pytest.raises(ValueError):
        parquet_sink(feed.stream(), folder, f"{folder}/c", partition_by="region", time_column="event_time")
    with pytest.raises(ValueError):
        console_sink(feed.stream(), "append", "")
    for trigger in ({"available_now": False}, {"every": "1 minute"}, {}):
        with pytest.raises(ValueError):
            triggered(feed.stream().writeStream, trigger)
    assert triggered(feed.stream().writeStream, {"processing_time": "1 minute"}) is not None


