"""The history of changes and quantile sketches, against brute force."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from millrace.functions.folders import stored
from millrace.operators import EventWindow, as_of, chain_breaks, decode_changes, history, pane_sketches, rank_error, split_changes, window_quantiles
from millrace.operators.history import with_next, with_previous
from millrace.sources.tables import ACCOUNT_ROW, change_log

CHANGE = "source_table string, op string, ts_ms bigint, offset bigint, before struct<id: bigint, v: string>, after struct<id: bigint, v: string>"


def random_changes(seed, keys=12, hot=150):
    """Coherent histories with deletes, returns, equal times and snapshots; one key has most changes; some are lost."""
    chosen, rows, offset = random.Random(seed), [], 0
    for key in range(keys):
        now = None
        for _ in range(hot if key == 0 else chosen.randrange(0, 12)):
            offset += 1
            before, op = now, "c" if now is None else chosen.choice("uuudr")
            now = None if op == "d" else (key, f"v{chosen.randrange(5)}")
            image = None if op in "cr" else before
            rows.append((chosen.choice(["t", None]) if key == 3 else "t", op, 10 * (offset // 3), offset, image, now))
    return rows, [row for row in rows if chosen.random() < 0.85]


def by_row(rows):
    found = {}
    for row in sorted(rows, key=lambda row: (row[2], row[3])):
        key = (row[5] or row[4])[0]
        found.setdefault((row[0], key), []).append(row)
    return found


def frame(spark, rows):
    return spark.createDataFrame(rows, CHANGE).repartition(7)


def tuples(df):
    return sorted(map(repr, (tuple(tuple(x) if isinstance(x, tuple) else x for x in row) for row in df.collect())))


@pytest.mark.parametrize("seed", [1, 2])
def test_breaks_by_brute_force(spark, seed):
    _, holed = random_changes(seed)
    wanted = []
    for (table, key), rows in by_row(holed).items():
        former = None
        for number, row in enumerate(rows):
            if row[1] != "r":
                if number == 0 and row[4] is not None:
                    wanted.append((table, key, row[2], row[3], row[1], "no_beginning"))
                elif number and row[4] != former:
                    wanted.append((table, key, row[2], row[3], row[1], "changed_between"))
            former = row[5]
    assert len(wanted) > 10
    assert tuples(chain_breaks(frame(spark, holed))) == sorted(map(repr, wanted))


def test_a_whole_history_has_no_breaks(spark):
    rows = [row for row in random_changes(3)[0] if (row[5] or row[4])[0] != 3]
    assert chain_breaks(frame(spark, rows)).count() == 0
    assert chain_breaks(frame(spark, [])).count() == 0


def brute_history(rows):
    found = []
    for (table, key), changes in by_row(rows).items():
        for row, following in zip(changes, [*changes[1:], None], strict=True):
            if row[5] is not None and (following is None or following[2] > row[2]):
                found.append((table, key, row[2], following and following[2], row[5]))
    return found


def test_history_and_lookups_by_brute_force(spark):
    rows = random_changes(4)[0]
    intervals = brute_history(rows)
    assert tuples(history(frame(spark, rows))) == sorted(map(repr, intervals))
    chosen = random.Random(9)
    asked = [(n, chosen.choice(["t", "t", None, "other"]), chosen.randrange(14), chosen.randrange(-5, 900)) for n in range(400)]
    wanted = []
    for n, table, key, at in asked:
        image = [i for t, k, since, until, i in intervals if (t, k) == (table, key) and since <= at and (until is None or at < until)]
        wanted.append((n, table, key, at, image[0] if image else None))
    lookups = spark.createDataFrame(asked, "n int, source_table string, row_key bigint, at_ms bigint").repartition(3)
    assert tuples(as_of(frame(spark, rows), lookups)) == sorted(map(repr, wanted))
    assert as_of(frame(spark, rows), lookups.where("false")).count() == 0


def test_a_hot_key_is_dealt_over_many_tasks(spark):
    df = spark.range(20_000).selectExpr("if(id % 10 = 0, 'rare', 'hot') k", "id at", "if(id % 7 = 0, id, null) v")
    placed = with_previous(df, ["k"], ["at"], F.col("v"), "former")
    text = placed._jdf.queryExecution().toString()
    assert "windowspecdefinition(__range" in text and "windowspecdefinition(k" not in text and "hashpartitioning(k" not in text
    last = {}
    for row in sorted(placed.collect(), key=lambda row: row["at"]):
        assert row["former"] == last.get(row["k"])
        if row["v"] is not None:
            last[row["k"]] = row["v"]


def test_changes_are_computed_once(spark):
    """Finding the bounds of ranges does not decode all changes a second time."""
    rows = random_changes(5)[0]
    for read in (history, chain_breaks, lambda changes: as_of(changes, changes.selectExpr("source_table", "after.id row_key", "ts_ms at_ms").limit(0))):
        computed = spark.sparkContext.accumulator(0)

        def counted(batches, computed=computed):
            for batch in batches:
                computed.add(len(batch))
                yield batch

        read(frame(spark, rows).mapInPandas(counted, CHANGE)).collect()
        assert computed.value == len(rows)


def test_only_what_a_history_needs_is_stored(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(sys.modules[history.__module__], "stored", lambda df: kept.append(df.columns) or stored(df))
    wide = frame(spark, random_changes(6)[0]).withColumn("source_version", F.lit("2.4.0"))
    history(wide)
    assert kept == [["source_table", "row_key", "ts_ms", "offset", "after"], ["source_table", "row_key", "ts_ms", "offset", "after", "__range"]]


def test_ranges_hold_no_more_rows_when_the_input_grows(spark):
    df = spark.range(0, 450_000, 1, 3).selectExpr("id % 3 k", "id at", "if(id % 7 = 0, id, null) v")
    for place in (with_previous, with_next):
        placed = place(df, ["k"], ["at"], F.col("v"), "near")
        counts = [row["n"] for row in spark.read.parquet(*placed.inputFiles()).groupBy("__range").agg(F.count("*").alias("n")).collect()]
        assert sum(counts) == 450_000 and len(counts) == 5 and max(counts) < 150_000
        # Values are multiples of 7 and 3 apart by key: the nearest of the same key is at most 21 away, and missing only at an end.
        side = F.col("at") - F.col("near") if place is with_previous else F.col("near") - F.col("at")
        wrong = placed.where(~side.between(1, 21) | (F.col("near") % 7 != 0) | (F.col("near") % 3 != F.col("k")))
        assert wrong.count() == 0 and 3 <= placed.where("near is null").count() <= 21


@pytest.mark.parametrize("backwards", [False, True])
def test_neighbours_by_brute_force(spark, backwards):
    chosen = random.Random(11)
    rows = [(chosen.choice(["a", "a", "b", None]), chosen.choice([None, *range(400)]), n, chosen.choice([None, n])) for n in range(900)]
    df = spark.createDataFrame(rows, "k string, at int, n int, v int").repartition(5)
    wanted, last = [], {}
    for row in sorted(rows, key=lambda row: (row[1] is not None, row[1] or 0, row[2]), reverse=backwards):
        wanted.append((*row, last.get(row[0])))
        last[row[0]] = last.get(row[0]) if row[3] is None else row[3]
    place = with_next if backwards else with_previous
    assert tuples(place(df, ["k"], ["at", "n"], F.col("v"), "near")) == sorted(map(repr, wanted))


def test_quantiles_are_as_near_as_stated(spark):
    n = 40_000
    df = spark.range(n).selectExpr("timestamp_micros(1700000000000000 + id % 50 * 600000000) event_time", "if(id % 3 = 0, 'a', 'b') k",
                                   "if(id % 1000 = 0, null, abs(xxhash64(id)) % 1000000 * (abs(xxhash64(id, 1)) % 7)) v")
    sketches = pane_sketches(df, "v", "1 hour", group_by=["k"])
    assert sketches.agg(F.max(F.length("sketch"))).first()[0] < 40_000
    found = window_quantiles(sketches, EventWindow("sliding", "3 hours", "1 hour"), "1 hour", group_by=["k"]).collect()
    assert len(found) > 10
    rows = [(row["event_time"], row["k"], row["v"]) for row in df.where("v is not null").collect()]
    for window in found:
        values = sorted(v for at, k, v in rows if k == window["k"] and window["window_start"] <= at < window["window_end"])
        assert window["n"] == len(values)
        for name, rank in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
            below, upto = sum(v < window[name] for v in values), sum(v <= window[name] for v in values)
            assert below / len(values) - 2 * rank_error() <= rank <= upto / len(values) + 2 * rank_error()


def test_quantiles_of_few_values_are_exact(spark):
    df = spark.range(1, 100).selectExpr("timestamp_micros(id) event_time", "id v")
    row = window_quantiles(pane_sketches(df, "v", "1 minute"), EventWindow("tumbling", "1 hour"), "1 minute").first()
    assert (row["n"], row["p50"], row["p95"], row["p99"]) == (99, 50, 95, 99)
    assert pane_sketches(df.where("false"), "v", "1 minute").count() == 0
    with pytest.raises(ValueError, match="make up"):
        window_quantiles(df, EventWindow("sliding", "1 hour", "7 minutes"), "2 minutes")
    with pytest.raises(ValueError, match="kind"):
        window_quantiles(df, EventWindow("session"), "2 minutes")


def test_history_of_a_large_table_is_made_by_many_tasks(spark, folder):
    """One row group of customers: no task decodes more than its share of the changes, and no interval is lost."""
    spark.range(0, 50_000, 1, 1).selectExpr(
        "id c_custkey", "concat('c', id) c_name", "cast(id % 5 - 1 as double) c_acctbal", "if(id % 2 = 0, 'MACHINERY', 'BUILDING') c_mktsegment"
    ).write.parquet(f"{folder}/customer.parquet")
    spark.range(0, 10, 1, 1).selectExpr("id s_suppkey", "concat('s', id) s_name", "1.0D s_acctbal").write.parquet(f"{folder}/supplier.parquet")
    known = split_changes(decode_changes(change_log(spark, folder), ACCOUNT_ROW))[0]
    counts = [row["n"] for row in known.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n")).collect()]
    assert sum(counts) == 50_000 + 25_000 + 10_000 + 20 and max(counts) < sum(counts) / 2
    found = history(known)
    assert found.count() == 50_000 + 25_000 + 20 and found.where("valid_to is null").count() == 40_000 + 10
