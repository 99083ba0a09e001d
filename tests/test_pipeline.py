"""Configuration, Kafka options, file logs, and whole pipelines."""

from datetime import datetime, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from streams import EVENT, GOLDEN, Feed, golden, rows

from millrace.operators import EventWindow, aggregate_windows, encode_events, to_log
from millrace.plans.config import PipelineConfig
from millrace.plans.pipeline import EventPipeline, session_settings
from millrace.sources import kafka_replay, kafka_stream, read_log, replay, replay_options, stream_options, write_log
from millrace.streaming import AVAILABLE_NOW, UpsertTable, kafka_options, merge_into
from millrace.streaming.files import SharedFiles

KAFKA = {"kafka": {"bootstrap_servers": "localhost:9092", "topics": ["orders", "order-events"]}}
SCHEMA = {"event_time": "timestamp", "k": "string", "q": "long"}


def test_kafka_stream_options():
    assert stream_options("h:1,h:2", ["orders", "order-events"]) == {
        "kafka.bootstrap.servers": "h:1,h:2",
        "subscribe": "orders,order-events",
        "startingOffsets": "latest",
        "failOnDataLoss": "false",
    }
    options = stream_options(
        "h:1", "orders", starting_offsets={"orders": {0: 5, 1: -2}}, fail_on_data_loss=True, max_offsets_per_trigger=100
    )
    assert options["startingOffsets"] == '{"orders": {"0": 5, "1": -2}}'
    assert (options["failOnDataLoss"], options["maxOffsetsPerTrigger"]) == ("true", "100")
    for servers, topics in (("", ["orders"]), ("h:1", []), ("h:1", [""])):
        with pytest.raises(ValueError):
            stream_options(servers, topics)


def test_kafka_replay_options():
    options = replay_options("h:1", ["orders"], start={"orders": {"0": 5}}, end="latest", min_partitions=64)
    assert options["failOnDataLoss"] == "true"
    assert options["startingOffsets"] == '{"orders": {"0": 5}}'
    assert (options["endingOffsets"], options["minPartitions"]) == ("latest", "64")
    timed = replay_options("h:1", ["orders"], start={"orders": {0: 1000}}, end={"orders": {0: 2000}}, by_timestamp=True)
    assert timed["startingOffsetsByTimestamp"] == '{"orders": {"0": 1000}}'
    assert timed["endingOffsetsByTimestamp"] == '{"orders": {"0": 2000}}'
    assert "startingOffsets" not in timed
    open_ended = replay_options("h:1", ["orders"], start={"orders": {0: 1000}}, by_timestamp=True)
    assert open_ended["endingOffsets"] == "latest"


def test_kafka_sink_options():
    assert kafka_options("h:1", "late-events") == {"kafka.bootstrap.servers": "h:1", "topic": "late-events"}
    with pytest.raises(ValueError):
        kafka_options("h:1", "")


def test_kafka_is_asked_for_by_its_name(spark, folder):
    """The connector is not installed here; Spark must get as far as looking for it."""
    calls = [
        lambda: kafka_stream(spark, "h:1", ["orders"]),
        lambda: kafka_replay(spark, "h:1", ["orders"]),
        lambda: EventPipeline({**KAFKA, "checkpoint": f"{folder}/c0"}).start(spark),
        lambda: EventPipeline(KAFKA).log_table(spark, start="earliest"),
    ]
    feed = Feed(spark, f"{folder}/in")
    feed.add(rows(GOLDEN[0]))
    output = {"type": "kafka", "bootstrap_servers": "h:1", "topic": "out"}
    pipeline = EventPipeline(
        {**base("events"), "output": output, "checkpoint": f"{folder}/c", "trigger": AVAILABLE_NOW}
    )
    calls.append(lambda: pipeline.start(spark, feed.stream()))
    late = {"path": f"{folder}/routed", "bootstrap_servers": "h:1", "topic": "late-events", "key": "k"}
    to_topic = EventPipeline({**base("events"), "late": late, "checkpoint": f"{folder}/c2", "trigger": AVAILABLE_NOW})
    calls.append(lambda: to_topic.start(spark, feed.stream()))
    for call in calls:
        with pytest.raises(PySparkException, match="(?i)kafka"):
            call()


def base(kind, **source):
    return {
        "source": {"type": kind, **source},
        "schema": SCHEMA,
        "processing": {"group_by": ["k"], "aggregations": {"event_count": "count(*)"}},
    }


def test_defaults():
    config = PipelineConfig.from_dict(KAFKA)
    assert (config.time_column, config.delay, config.window) == ("event_time", "10 minutes", EventWindow())
    assert config.group_by == ("event_type",) and config.output.kind == "console"
    assert list(config.aggregations) == ["event_count", "total_quantity", "avg_price"]
    sliding = PipelineConfig.from_dict({**KAFKA, "processing": {"window_type": "sliding"}})
    assert sliding.window == EventWindow("sliding", "5 minutes", "1 minute")


def test_a_whole_configuration(spark):
    config = PipelineConfig.from_dict(
        {
            "kafka": {**KAFKA["kafka"], "starting_offsets": "latest", "fail_on_data_loss": "false"},
            "schema": {"order_id": "string", "quantity": "integer", "event_time": "timestamp"},
            "watermark": {"column": "event_time", "delay": "10 minutes"},
            "processing": {"window_type": "none"},
            "output": {"type": "parquet", "path": "/somewhere", "partition_by": "event_date"},
            "checkpoint": "/elsewhere",
            "app_name": "orders",
            "shuffle_partitions": 4,
        }
    )
    assert config.schema.names == ["order_id", "quantity", "event_time"] and config.required == ("event_time",)
    settings = session_settings(config)
    assert settings["spark.sql.shuffle.partitions"] == "4" and settings["spark.sql.session.timeZone"] == "UTC"


@pytest.mark.parametrize(
    "wrong",
    [
        {},
        {"kafka": {"topics": ["orders"]}},
        {**KAFKA, "outputs": {}},
        {**KAFKA, "output": {"type": "csv"}},
        {**KAFKA, "output": {"type": "parquet"}},
        {**KAFKA, "output": {"type": "kafka", "topic": "t"}},
        {**KAFKA, "output": {"type": "table"}},
        {**KAFKA, "output": {"type": "console", "pth": "x"}},
        {**KAFKA, "processing": {"window_type": "hopping"}},
        {**KAFKA, "processing": {"window_type": "session", "group_by": []}},
        {**KAFKA, "processing": {"aggregations": {"m": "median(quantity)"}}},
        {**KAFKA, "processing": {"aggregations": {"m": "sum(price)"}}},
        {**KAFKA, "processing": {"group_by": ["colour"]}},
        {**KAFKA, "schema": {"a": "strin"}},
        {**KAFKA, "watermark": {"delay": "a while"}},
        {**KAFKA, "watermark": {"column": "eventtime"}},
        {**KAFKA, "late": {"path": "x", "max_lateness": "never"}},
        {**KAFKA, "late": {"path": "x"}, "quarantine": {"path": "y"}},
        {**KAFKA, "late": {"path": "x", "topic": "late-events"}},
        {**KAFKA, "quarantine": {"bad_events": "quarantine"}},
        {**KAFKA, "quarantine": {"bad_events": "drop", "path": "y"}},
        {**KAFKA, "quarantine": {"bad_events": "ignore"}},
        {**KAFKA, "processing": {"window_type": "sliding", "panes": True}},
        {**KAFKA, "processing": {"panes": True}, "late": {"path": "x"}, "output": {"type": "parquet", "path": "y"}},
        {**KAFKA, "late": {"topic": "late-events", "bootstrap_servers": "h:1"}},
        {"source": {"type": "files"}},
        {"source": {"type": "socket"}},
    ],
)
def test_wrong_configurations_are_refused(spark, wrong):
    with pytest.raises(ValueError):
        EventPipeline(wrong)


def messages(spark, batch, extra=()):
    events = spark.createDataFrame(rows(batch), EVENT)
    log = to_log(
        events.withColumn("id", F.monotonically_increasing_id()),
        key="k",
        columns=["event_time", "k", "q"],
        topic="orders",
        partition=F.lit(0),
        offset=F.col("id"),
        timestamp=F.col("kafka_timestamp"),
    )
    for text in extra:
        log = log.withColumn("value", F.when(F.col("key") == b"bad", F.lit(text).cast("binary")).otherwise(F.col("value")))
    return log


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_file_logs_are_read_back_and_replayed(spark, folder, format):
    log = messages(spark, GOLDEN[2])
    write_log(log, folder, format=format)
    again = read_log(spark, folder, format=format)
    assert again.columns == log.columns
    assert again.exceptAll(log).isEmpty() and log.exceptAll(again).isEmpty()
    first = sorted(row["offset"] for row in again.collect())[0]
    assert replay(again, offsets={0: (first, first + 1)}).count() == 1
    assert replay(again, offsets={1: (0, 10)}).isEmpty()
    assert replay(again, topics=["other"]).isEmpty()
    arrived = datetime(2024, 1, 1, 0, 50, tzinfo=timezone.utc)
    assert replay(again, since=arrived).count() == 5 and replay(again, until=arrived).isEmpty()
    with pytest.raises(ValueError):
        read_log(spark, folder, format="avro")


def test_replayed_logs_prune_directories_and_push_filters(spark, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    write_log(messages(spark, GOLDEN[2]), folder)
    part = replay(read_log(spark, folder), offsets={0: (0, 10)}, since=datetime(2024, 1, 1))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "partition#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    pushed = plan.split("PushedFilters")[1]
    assert "GreaterThanOrEqual(offset" in pushed and "GreaterThanOrEqual(timestamp" in pushed


def test_one_pipeline_for_a_log_as_table_and_as_stream(spark, folder):
    for number, batch in enumerate(GOLDEN):
        write_log(messages(spark, batch), f"{folder}/log")
    config = {
        **base("files", path=f"{folder}/log"),
        "watermark": {"delay": "2 days"},
        "output": {"type": "table", "path": f"{folder}/table"},
        "checkpoint": f"{folder}/c",
        "trigger": AVAILABLE_NOW,
    }
    pipeline = EventPipeline(config)
    whole = pipeline.on_table(pipeline.log_table(spark))
    every = pipeline.log_table(spark).count()
    parts = [pipeline.log_table(spark, **bounds).count() for bounds in ({"offsets": {0: (0, 1 << 60)}}, {"topics": ["none"]}, {"offsets": {1: (0, 9)}})]
    assert parts == [every, 0, 0] and every
    queries = pipeline.start(spark)
    pipeline.await_all()
    assert len(queries) == 1 and queries[0].exception() is None
    read = pipeline.upserted().read(spark).select(*whole.columns)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, whole.collect())) and not whole.isEmpty()


def test_quarantine_beside_the_result(spark, folder):
    write_log(messages(spark, ["01:00 a", "01:00 bad", "59:00 b"], ["[1]"]), f"{folder}/log")
    pipeline = EventPipeline(
        {
            **base("files", path=f"{folder}/log"),
            "quarantine": {"path": f"{folder}/quarantine"},
            "output": {"type": "parquet", "path": f"{folder}/out"},
            "checkpoint": f"{folder}/c",
            "trigger": AVAILABLE_NOW,
        }
    )
    assert len(pipeline.start(spark)) == 2
    pipeline.await_all()
    bad = spark.read.parquet(f"{folder}/quarantine").collect()
    assert [(r["key"], r["raw_value"], r["quarantine_reason"]) for r in bad] == [("bad", "[1]", "malformed_json")]
    assert [r["k"] for r in spark.read.parquet(f"{folder}/out").collect()] == ["a"]


def test_bad_events_fail_or_are_dropped(spark, folder):
    write_log(messages(spark, ["01:00 a", "01:00 bad", "02:00 b"], ["[1]"]), f"{folder}/log")
    config = {
        **base("files", path=f"{folder}/log"),
        "required": ["k", "event_time"],
        "output": {"type": "table", "path": f"{folder}/out"},
        "trigger": AVAILABLE_NOW,
    }
    with pytest.raises(ValueError, match="checkpoint"):
        EventPipeline(config).start(spark)
    failing = EventPipeline({**config, "checkpoint": f"{folder}/c"})
    failing.start(spark)
    with pytest.raises(Exception, match="bad event at orders/0"):
        failing.await_all()
    with pytest.raises(Exception, match="malformed_json"):
        failing.on_table(failing.log_table(spark)).collect()
    dropping = EventPipeline({**config, "checkpoint": f"{folder}/c2", "quarantine": {"bad_events": "drop"}})
    dropping.start(spark)
    assert dropping.await_all(120)
    assert sorted(r["k"] for r in dropping.upserted().read(spark).collect()) == ["a", "b"]


def test_the_first_failure_stops_the_other_queries(spark, folder, monkeypatch):
    feed = golden(spark, f"{folder}/in")
    output = {"type": "table", "path": f"{folder}/t"}
    late = {"path": f"{folder}/routed"}
    pipeline = EventPipeline({**base("events"), "late": late, "output": output, "checkpoint": f"{folder}/c"})
    router, result = pipeline.start(spark, feed.stream())
    assert not pipeline.await_all(1)
    result.stop()
    monkeypatch.setattr("millrace.streaming.router.writer_of", lambda batch: "another")
    feed.add(rows(["59:00 a"]))
    with pytest.raises(Exception, match="another checkpoint"):
        pipeline.await_all(120)
    assert not any(query.isActive for query in pipeline.queries)


def test_a_backlog_is_read_some_batches_at_a_time(spark, folder):
    for batch in GOLDEN:
        write_log(messages(spark, batch), f"{folder}/log")
    config = {
        **base("files", path=f"{folder}/log", max_files_per_trigger=1),
        "late": {"path": f"{folder}/routed", "max_batches": 1},
        "output": {"type": "table", "path": f"{folder}/table"},
        "checkpoint": f"{folder}/c",
        "trigger": AVAILABLE_NOW,
    }
    pipeline = EventPipeline(config)
    pipeline.start(spark)
    assert pipeline.await_all(120)
    on_time = pipeline.router().read_on_time(spark, pipeline.decode(pipeline.log_table(spark)).schema)
    expected = aggregate_windows(on_time, EventWindow(), group_by=["k"])
    table = pipeline.upserted().read(spark).select(*expected.columns)
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, expected.collect()))
    assert SharedFiles(spark).names(f"{folder}/routed/waiting") == []


def test_pipeline_with_late_router(spark, folder):
    for batch in GOLDEN:
        write_log(messages(spark, [*batch, "45:00 bad"], ["{"]), f"{folder}/log")
        pipeline = EventPipeline(
            {
                **base("files", path=f"{folder}/log"),
                "late": {"path": f"{folder}/routed"},
                "output": {"type": "table", "path": f"{folder}/table"},
                "checkpoint": f"{folder}/c",
                "trigger": AVAILABLE_NOW,
            }
        )
        pipeline.start(spark)
        pipeline.await_all()
        assert all(query.exception() is None for query in pipeline.queries)
    router, schema = pipeline.router(), pipeline.decode(pipeline.log_table(spark)).schema
    late = router.read_late(spark, schema)
    assert sorted(r["batch_id"] for r in late.collect()) == [2, 2, 2, 2, 2, 5, 5]
    assert spark.read.parquet(f"{folder}/routed/quarantine").count() == len(GOLDEN)
    on_time = router.read_on_time(spark, schema)
    table = pipeline.upserted().read(spark)
    expected = aggregate_windows(on_time, EventWindow(), group_by=["k"])
    assert sorted(map(tuple, table.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))


def test_late_events_as_messages(spark, folder):
    feed = Feed(spark, f"{folder}/in")
    for batch in GOLDEN[:3]:
        feed.add(rows(batch))
    pipeline = EventPipeline({**base("events"), "late": {"path": f"{folder}/routed"}, "trigger": AVAILABLE_NOW})
    router = pipeline.router()
    router.start(feed.stream(), AVAILABLE_NOW).awaitTermination()
    sent = encode_events(router.late_stream(spark, EVENT), "k")
    query = sent.writeStream.format("parquet").option("path", f"{folder}/out").trigger(availableNow=True)
    query.option("checkpointLocation", f"{folder}/c").start().awaitTermination()
    messages = spark.read.parquet(f"{folder}/out").collect()
    assert sorted(m["key"] for m in messages) == ["a", "a", "a", "a", "b"]
    assert all('"lateness_class":"within_max"' in m["value"] for m in messages)


def test_pass_through_and_stop(spark, folder):
    feed = Feed(spark, f"{folder}/in")
    feed.add(rows(GOLDEN[0]))
    pipeline = EventPipeline(
        {
            **base("events"),
            "processing": {"window_type": "none"},
            "output": {"type": "parquet", "path": f"{folder}/out"},
            "checkpoint": f"{folder}/c",
        }
    )
    (query,) = pipeline.start(spark, feed.stream())
    with pytest.raises(RuntimeError):
        pipeline.start(spark, feed.stream())
    query.processAllAvailable()
    pipeline.stop()
    assert not query.isActive
    assert spark.read.parquet(f"{folder}/out").count() == 2


def test_upserting_events_needs_a_key(spark, folder):
    output = {"type": "table", "path": f"{folder}/t"}
    pipeline = EventPipeline({**base("events"), "processing": {"window_type": "none"}, "output": output})
    feed = Feed(spark, f"{folder}/in")
    feed.add(rows(GOLDEN[0]))
    with pytest.raises(ValueError):
        pipeline.start(spark, feed.stream())
    with pytest.raises(ValueError):
        merge_into("t", [])
    assert UpsertTable(folder, ["k"]).keys == ["k"]
