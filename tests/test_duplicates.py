"""Duplicates long after the watermark, against a set of what was seen."""

import random
from datetime import timedelta

import pytest
from streams import EVENT, Feed, at

from millrace.streaming import AVAILABLE_NOW, UniqueEvents, run, table_sink
from millrace.streaming.files import SharedFiles

DAY = timedelta(days=1)


def arrivals(seed, days=10, a_day=60):
    """Events of each day, and copies of earlier ones, some many days later; keys are time and name."""
    chosen, seen, batches = random.Random(seed), [], []
    for day in range(days):
        fresh = [(at(f"{day * 1440 + chosen.randrange(1440)}:00"), f"k{n}", n, at(f"{day * 1440 + 5}:00")) for n in range(a_day)]
        again = [(*event[:3], at(f"{day * 1440 + 7}:00")) for event in chosen.sample(seen, min(len(seen), 15))]
        batches.append(fresh + again + chosen.sample(fresh, 5))
        seen += fresh
    return batches


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_copies_of_any_day_are_removed_and_nothing_else(spark, folder, bits):
    """Also with filters so full that every event has to be looked up."""
    feed, unique = Feed(spark, f"{folder}/in"), UniqueEvents(f"{folder}/u", ["event_time", "k"], bits=bits)
    for batch in arrivals(1, days=6):
        feed.add(batch)
        for _ in range(2):
            run(table_sink(feed.stream(), unique.apply_batch, "append", f"{folder}/c"), AVAILABLE_NOW).awaitTermination()
    got = sorted((row["event_time"], row["k"]) for row in unique.read(spark).collect())
    assert got == sorted({(row["event_time"], row["k"]) for row in feed.table().collect()})
    assert unique.read(spark).columns == EVENT.names


def test_what_is_known_is_bounded_by_days(spark, folder):
    event = (at("00:00"), "a", 1)
    unique = UniqueEvents(folder, ["event_time", "k"], days=3)
    for number, day in enumerate((0, 3, 6, 10)):
        unique.apply_batch(spark.createDataFrame([(*event, at("00:00") + day * DAY)], EVENT), number)
    # Three days after the first it is a copy; then nothing of the last three days is known.
    assert sorted(row["kafka_timestamp"].day for row in unique.read(spark).collect()) == [1, 7, 11]


def test_batches_cut_short_are_completed_alike(spark, folder, monkeypatch):
    unique, publish = UniqueEvents(folder, ["k"]), SharedFiles.publish
    one = spark.createDataFrame([(at("00:00"), "a", 1, at("01:00")), (at("00:00"), "b", 1, None)], EVENT)
    two = spark.createDataFrame([(at("00:00"), name, 2, at("02:00")) for name in "abc"], EVENT)

    def crashing(self, staged, path):
        if "filters" in path:
            raise OSError("lost")
        return publish(self, staged, path)

    monkeypatch.setattr(SharedFiles, "publish", crashing)
    with pytest.raises(OSError, match="lost"):
        unique.apply_batch(one, 0)
    monkeypatch.setattr(SharedFiles, "publish", publish)
    for batch, number in ((one, 0), (one, 0), (two, 1), (two, 1), (two.where("false"), 2)):
        unique.apply_batch(batch, number)
    # An event without arrival time is of no day, so its copy isn't known.
    assert sorted((row["k"], row["q"]) for row in unique.read(spark).collect()) == [("a", 1), ("b", 1), ("b", 2), ("c", 2)]
    with pytest.raises(ValueError):
        UniqueEvents(folder, ["k"], bits=100)
