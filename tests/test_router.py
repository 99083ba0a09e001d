"""The late router: golden micro-batches, repeated batches, crashes, restarts."""

import time
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from streams import EVENT, GOLDEN, Feed, at, golden, rows

from millrace.operators import EventWindow, aggregate_windows, reprocess, with_event_watermark
from millrace.streaming import AVAILABLE_NOW, LATE, ON_TIME, QUARANTINE, LateRouter
from millrace.streaming.files import SharedFiles
from millrace.streaming.router import ReaderPace


def finished(query):
    query.awaitTermination(180)
    assert query.exception() is None
    return query


def routed(router, feed, files_per_trigger=1):
    return finished(router.start(feed.stream(files_per_trigger), AVAILABLE_NOW))


def content(df):
    return sorted((row["event_time"], row["k"]) for row in df.select("event_time", "k").collect())


def expected(*batches):
    return content_of([row for number in batches for row in rows(GOLDEN[number])])


def content_of(batch):
    return sorted((time.replace(tzinfo=None), key) for time, key, *_ in batch)


def test_golden_batches(spark, folder):
    feed, router = golden(spark, f"{folder}/in"), LateRouter(f"{folder}/routed")
    routed(router, feed)
    late = router.read_late(spark, EVENT)
    assert content(router.read_on_time(spark, EVENT)) == expected(0, 1, 3, 4)
    assert content(late) == expected(2, 5)
    described = late.where("k = 'b' and batch_id = 5").orderBy("event_time").first()
    assert described["lateness_seconds"] == 21 * 60 and described["lateness_class"] == "within_max"
    assert described["_late_metadata"]["reason"] == "late_arrival"
    assert described["_late_metadata"]["routed_at"] is not None


@pytest.mark.parametrize("release", [1, 2, 1000, None])
def test_nothing_is_lost_behind_the_router(spark, folder, release):
    """Batches of many files, read so many batches at a time."""
    feed, router = Feed(spark, f"{folder}/in"), LateRouter(f"{folder}/routed", release=release)
    for batch in GOLDEN:
        feed.add(rows(batch))
        query = router.start(feed.stream().repartition(5), AVAILABLE_NOW)
        finished(query)
    with pytest.raises(ValueError, match="take batches apart"):
        router.on_time_stream(spark, EVENT, maxFilesPerTrigger="1")
    dropped, runs = [], 0
    while router.release(spark) or not runs:
        router.note_read(spark)
        stream = with_event_watermark(router.on_time_stream(spark, EVENT))
        result = aggregate_windows(stream, EventWindow(), group_by=["k"])
        query = result.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append")
        query = finished(query.option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start())
        dropped += [op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"]]
        runs += 1
    assert dropped and sum(dropped) == 0 and runs == {1: 4, 2: 2}.get(release, 1)

    on_time, late = router.read_on_time(spark, EVENT), router.read_late(spark, EVENT)
    both = on_time.drop("batch_id", "utc_date").unionByName(late.select(EVENT.names))
    assert both.exceptAll(feed.table()).isEmpty() and feed.table().exceptAll(both).isEmpty()
    corrected = reprocess(on_time, late, EventWindow(), group_by=["k"])
    keys = ["window_start", "window_end", "k"]
    merged = aggregate_windows(on_time, EventWindow(), group_by=["k"]).join(corrected, keys, "left_anti")
    whole = aggregate_windows(feed.table(), EventWindow(), group_by=["k"])
    assert sorted(map(tuple, merged.unionByName(corrected).collect())) == sorted(map(tuple, whole.collect()))


def test_restarts_go_on_where_the_router_stopped(spark, folder):
    feed = Feed(spark, f"{folder}/in")
    for batch in GOLDEN:
        feed.add(rows(batch))
        routed(LateRouter(f"{folder}/routed"), feed)
    router = LateRouter(f"{folder}/routed")
    assert content(router.read_on_time(spark, EVENT)) == expected(0, 1, 3, 4)
    assert content(router.read_late(spark, EVENT)) == expected(2, 5)


def batches(spark, *numbers):
    return [spark.createDataFrame(rows(GOLDEN[number]), EVENT) for number in numbers]


def test_a_repeated_batch_changes_nothing(spark, folder):
    router = LateRouter(folder)
    for number, batch in enumerate(batches(spark, 0, 1, 2)):
        router.route_batch(batch, number)
        router.route_batch(batch, number)
    router.route_batch(batches(spark, 2)[0], 2)
    assert content(router.read_on_time(spark, EVENT)) == expected(0, 1)
    assert content(router.read_late(spark, EVENT)) == expected(2)


@pytest.mark.parametrize("renames", [0, 1, 2])
def test_a_crash_while_publishing_is_made_good_by_the_repeated_batch(spark, folder, monkeypatch, renames):
    router = LateRouter(folder)
    mixed = spark.createDataFrame(rows(["02:00 a", "30:00 a"]), EVENT)
    router.route_batch(batches(spark, 0)[0], 0)
    publish, done = SharedFiles.publish, []

    def crashing(self, staged, path):
        if len(done) == renames:
            raise OSError("lost")
        done.append(path)
        return publish(self, staged, path)

    monkeypatch.setattr(SharedFiles, "publish", crashing)
    with pytest.raises(OSError, match="lost"):
        router.route_batch(mixed, 1)
    monkeypatch.setattr(SharedFiles, "publish", publish)
    router.route_batch(mixed, 1)
    router.route_batch(batches(spark, 3)[0], 2)
    assert content(router.read_on_time(spark, EVENT)) == content_of(rows(["01:00 a", "20:00 a", "30:00 a", "40:00 a"]))
    assert content(router.read_late(spark, EVENT)) == content_of(rows(["02:00 a"]))


def test_a_crash_before_the_record_is_made_good_too(spark, folder, monkeypatch):
    router, write = LateRouter(folder), SharedFiles.write_json

    def crashing(self, path, content, *, keep=False):
        if "_marks" in path:
            raise OSError("lost")
        return write(self, path, content, keep=keep)

    monkeypatch.setattr(SharedFiles, "write_json", crashing)
    with pytest.raises(OSError, match="lost"):
        router.route_batch(batches(spark, 0)[0], 0)
    monkeypatch.setattr(SharedFiles, "write_json", write)
    for number, batch in enumerate(batches(spark, 0, 2)):
        router.route_batch(batch, number)
    assert content(router.read_on_time(spark, EVENT)) == content_of(rows(["01:00 a", "20:00 a", "10:00 a"]))
    assert len(router.read_late(spark, EVENT).collect()) == 4


def test_sized_files(spark, folder):
    many = spark.createDataFrame(rows(["02:00 a", "30:00 a"] * 40), EVENT).repartition(8)
    for name, sized in (("as_read", False), ("sized", True)):
        router = LateRouter(f"{folder}/{name}", sized_files=sized)
        router.route_batch(batches(spark, 0)[0], 0)
        router.route_batch(many, 1)
        files = [n for n in SharedFiles(spark).names(f"{router.path(LATE)}/batch_id=1/utc_date=2024-01-01") if n.endswith(".parquet")]
        assert len(files) == (1 if sized else 8)
        assert router.read_late(spark, EVENT).count() == 40 and router.read_on_time(spark, EVENT).count() == 42


def test_empty_batches_and_batches_without_times_keep_the_watermark(spark, folder):
    router = LateRouter(folder)
    untimed = [(None, "a", 1, at("50:00"))]
    for number, batch in enumerate([rows(GOLDEN[0]), [], untimed, rows(["09:00 a", "10:00 a"])]):
        router.route_batch(spark.createDataFrame(batch, EVENT), number)
    assert content(router.read_late(spark, EVENT)) == content_of(rows(["09:00 a"]))
    assert content(router.read_on_time(spark, EVENT)) == content_of(rows(["01:00 a", "20:00 a", "10:00 a"]))
    assert [r["quarantine_reason"] for r in router.read_quarantine(spark, EVENT).collect()] == ["missing_required"]


def test_bad_events_go_to_quarantine_and_do_not_move_the_watermark(spark, folder):
    router = LateRouter(folder)
    first = spark.createDataFrame(rows(["59:00 bad", "20:00 a"]), EVENT)
    reason = F.when(F.col("k") == "bad", "malformed_json")
    router.route_batch(first.withColumn("quarantine_reason", reason).withColumn("raw_value", F.lit("?")), 0)
    checked = spark.createDataFrame(rows(["10:00 a"]), EVENT)
    nothing = F.lit(None).cast("string")
    router.route_batch(checked.withColumn("quarantine_reason", nothing).withColumn("raw_value", nothing), 1)
    assert content(router.read_on_time(spark, EVENT)) == content_of(rows(["10:00 a", "20:00 a"]))
    files = SharedFiles(spark)
    assert files.names(router.path(QUARANTINE)) == ["batch_id=0"] and files.names(router.path(LATE)) == []
    assert files.names(router.path(ON_TIME)) == ["batch_id=0", "batch_id=1"]


def test_a_root_of_another_checkpoint_is_refused(spark, folder):
    with pytest.raises(ValueError, match="another checkpoint"):
        LateRouter(folder).route_batch(batches(spark, 0)[0], 3)


def test_a_new_checkpoint_over_an_old_root_is_refused(spark, folder):
    feed = golden(spark, f"{folder}/in")
    router = LateRouter(f"{folder}/routed")
    routed(router, feed)
    before = content(router.read_on_time(spark, EVENT))
    SharedFiles(spark).discard(router.checkpoint)
    feed.add(rows(["59:00 a"]))
    query = LateRouter(f"{folder}/routed").start(feed.stream(), AVAILABLE_NOW)
    with pytest.raises(Exception, match="another checkpoint"):
        query.awaitTermination()
    assert content(router.read_on_time(spark, EVENT)) == before


def test_old_records_are_removed(spark, folder, monkeypatch):
    monkeypatch.setattr("millrace.streaming.router.MARKS_KEPT", 2)
    router = LateRouter(folder)
    for number in range(5):
        router.route_batch(batches(spark, 0)[0], number)
    assert SharedFiles(spark).names(f"{folder}/_marks") == ["3.json", "4.json"]


def test_a_clock_far_ahead_makes_no_other_event_late(spark, folder):
    router, arrival = LateRouter(folder), at("50:00")
    ahead = at("50:00") + timedelta(days=365 * 75)
    frames = [rows(["01:00 a", "20:00 a"]), [*rows(["21:00 a"]), (ahead, "wrong", 1, arrival)], rows(["22:00 a"]), rows(["23:00 a"]), rows(["24:00 a"])]
    for number, batch in enumerate(frames):
        router.route_batch(spark.createDataFrame(batch, EVENT), number)
    assert SharedFiles(spark).names(router.path(LATE)) == []
    assert content(router.read_on_time(spark, EVENT)) == content_of([row for batch in frames for row in batch if row[1] == "a"])
    bad = router.read_quarantine(spark, EVENT).collect()
    assert [(row["k"], row["quarantine_reason"]) for row in bad] == [("wrong", "future_time")]


def test_bounds_of_event_times(spark, folder):
    untold = [(at("59:00"), "no arrival", 1, None)]
    batch = [*rows(["50:00 just", "51:00 ahead", "40:00 behind", "39:59 far behind"], "50:00"), *untold]
    router = LateRouter(folder, max_ahead="59 seconds", max_behind="10 minutes")
    router.route_batch(spark.createDataFrame(batch, EVENT), 0)
    kept = {row["k"] for row in router.read_on_time(spark, EVENT).collect()}
    assert kept == {"just", "behind", "no arrival"}
    reasons = {row["k"]: row["quarantine_reason"] for row in router.read_quarantine(spark, EVENT).collect()}
    assert set(reasons.values()) == {"future_time", "past_time"}
    unbounded = LateRouter(f"{folder}/unbounded", max_ahead=None)
    unbounded.route_batch(spark.createDataFrame(batch, EVENT), 0)
    assert unbounded.read_on_time(spark, EVENT).count() == len(batch)
    with pytest.raises(ValueError):
        LateRouter(folder, max_ahead="1 month")


def test_batches_wait_for_a_slow_reader(spark, folder):
    router, files = LateRouter(folder, release=2), SharedFiles(spark)
    for number in range(7):
        router.route_batch(batches(spark, 0)[0], number)
        router.release(spark)
    assert files.names(router.path(ON_TIME)) == ["batch_id=0", "batch_id=1"] and router.waiting(spark) == 5
    assert router.release(spark) == 0
    router.note_read(spark, 0)
    assert router.release(spark) == 1 and router.release(spark) == 0
    router.note_read(spark)
    router.note_read(spark, 1)
    assert LateRouter(folder, release=2).release(spark) == 2 and router.waiting(spark) == 2
    router.note_read(spark)
    assert router.release(spark) == 2 and router.release(spark) == 0 and router.waiting(spark) == 0


def settle(condition, seconds=90):
    until = time.monotonic() + seconds
    while not condition() and time.monotonic() < until:
        time.sleep(0.2)
    assert condition()


def test_a_running_reader_never_gets_more_than_it_may(spark, folder):
    feed = Feed(spark, f"{folder}/in")
    for number in range(9):
        feed.add(rows([f"{number + 1:02d}:00 a", f"{number + 1:02d}:30 b"]))
    router = LateRouter(f"{folder}/routed", release=2)
    routing = router.start(feed.stream(), {"processing_time": "100 milliseconds"})
    try:
        settle(lambda: router.waiting(spark) == 7)
        pace, sizes = router.follow(spark), []
        write = router.on_time_stream(spark, EVENT).writeStream.foreachBatch(lambda batch, _: sizes.append(batch.count()))
        reader = write.option("checkpointLocation", f"{folder}/c").trigger(processingTime="200 milliseconds").start()
        pace.of(reader)
        settle(lambda: sum(sizes) == 18)
        reader.stop()
        spark.streams.removeListener(pace)
        assert max(sizes) <= 4 and len(sizes) >= 5
    finally:
        routing.stop()


def test_a_reader_whose_report_was_lost_goes_on_when_idle(spark, folder):
    router = LateRouter(folder, release=1)
    for number in range(2):
        router.route_batch(batches(spark, 0)[0], number)
    router.release(spark)
    pace = ReaderPace(spark, router)
    pace.query = "q"
    idle = lambda when, query="q": SimpleNamespace(id=query, timestamp=when.isoformat().replace("+00:00", "Z"))
    now = datetime.now(timezone.utc)
    pace.onQueryIdle(idle(now))
    pace.onQueryIdle(idle(now - timedelta(seconds=5)))
    pace.onQueryIdle(idle(now + timedelta(seconds=60), "other"))
    assert router.waiting(spark) == 1
    pace.onQueryIdle(idle(datetime.now(timezone.utc) + timedelta(seconds=60)))
    assert router.waiting(spark) == 0
