"""Queries for the log, decoding, quarantine, duplicates and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.folders import new_folder
from millrace.functions.schemas import ORDER_EVENT_WITH_METADATA
from millrace.functions.types import schema_from_config
from millrace.operators.decode import (
    decode_checked,
    decode_events,
    encode_events,
    flatten_metadata,
)
from millrace.operators.dedup import deduplicate
from millrace.plans.pipeline import EventPipeline
from millrace.plans.registry import query
from millrace.plans.window_queries import METRICS, ORDERS, PASSED, cores, orders, plain, sessions, sliding, tumbling
from millrace.sources.event_log import read_log, replay, stream_log, write_log
from millrace.sources.tables import EXACT_ORDER, events, events_stream, fed_in_turns, order_events, order_log, redelivered, spoiled_log
from millrace.streaming.duplicates import UniqueEvents
from millrace.streaming.sinks import parquet_sink, run, table_sink
from millrace.streaming.triggers import AVAILABLE_NOW
from millrace.streaming.upsert import UpsertTable


# Longer than the data: no copy and no row of a later turn is too late.
WHOLE_HISTORY = "365 days"
DECODED = "order_id, customer_id, product_id, quantity, unit_price::double unit_price, event_time, event_type"
PLACED = "(cast(order_id as bigint) % 3)::int as \"partition\", cast(order_id as bigint) // 3 as \"offset\""
LINEAGE_SQL = (
    f"select {DECODED}, arrival kafka_timestamp, order_id \"key\", 'orders' topic, {PLACED} from ({ORDERS})"
)


def log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_log(events(spark, sf_dir))


@query("decode_events", f"select {DECODED}, arrival kafka_timestamp from ({ORDERS})")
def decode_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(decode_events(log_table(spark, sf_dir)))


@query(
    "decode_custom_schema",
    f"select order_id, quantity, event_time, arrival kafka_timestamp from ({ORDERS})",
)
def decode_custom_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = schema_from_config({"order_id": "string", "quantity": "Integer", "event_time": "TIMESTAMP"})
    return plain(decode_events(log_table(spark, sf_dir), schema))


@query(
    "decode_with_metadata",
    f"""select {DECODED}, arrival kafka_timestamp,
          ['PENDING', 'CONFIRMED', 'SHIPPED', 'DELIVERED'][cast(order_id as bigint) % 4 + 1] status,
          ['CREDIT_CARD', 'PAYPAL', 'APPLE_PAY', 'DEBIT_CARD'][cast(customer_id as bigint) % 4 + 1] payment_method,
          'tables' producer, arrival > event_time is_late, arrival produced_at
        from ({ORDERS})""",
)
def decode_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(flatten_metadata(decode_events(log_table(spark, sf_dir), ORDER_EVENT_WITH_METADATA)))


@query("log_lineage", LINEAGE_SQL)
def log_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(decode_events(log_table(spark, sf_dir), schema_from_config(EXACT_ORDER), lineage=True))


@query(
    "quarantine",
    f"""select order_id "key", {PLACED},
          case when quantity >= 25 then 'accepted'
               when event_type in ('view', 'signup') then 'missing_required' else 'malformed_json' end outcome,
          case when quantity >= 25 then customer_id else '' end customer_id
        from ({ORDERS})""",
)
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = decode_checked(spoiled_log(events(spark, sf_dir)), schema_from_config(EXACT_ORDER))
    reason = F.col("quarantine_reason")
    return checked.select(
        "key",
        "partition",
        "offset",
        F.coalesce(reason, F.lit("accepted")).alias("outcome"),
        F.when(reason.isNull(), F.col("customer_id")).otherwise("").alias("customer_id"),
    )


@query("encode_events", f"select order_id \"key\", {DECODED} from ({ORDERS})")
def encode_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded again, as JSON text of timestamps differs between engines."""
    source = orders(spark, sf_dir).withColumn("event_time", F.col("event_time").cast("timestamp"))
    messages = encode_events(source, "order_id", list(EXACT_ORDER))
    decoded = messages.select("key", F.from_json("value", schema_from_config(EXACT_ORDER)).alias("event")).select("key", "event.*")
    return plain(decoded)


@query("log_scan", LINEAGE_SQL)
def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as files, read as a stream, decoded with lineage and appended to parquet."""
    folder = new_folder(spark, "scan")
    write_log(log_table(spark, sf_dir), f"{folder}/log")
    decoded = decode_events(stream_log(spark, f"{folder}/log"), schema_from_config(EXACT_ORDER), lineage=True)
    sink = parquet_sink(decoded, f"{folder}/out", f"{folder}/checkpoint", partition_by=None)
    run(sink, AVAILABLE_NOW).awaitTermination()
    return plain(spark.read.parquet(f"{folder}/out"))


@query(
    "log_replay",
    f"""{LINEAGE_SQL} where arrival >= timestamp '2024-01-08' and arrival < timestamp '2024-01-22'""",
)
def log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weeks of a file log."""
    folder = new_folder(spark, "replay")
    write_log(log_table(spark, sf_dir), folder)
    part = replay(
        read_log(spark, folder),
        topics=["orders"],
        since=F.to_timestamp(F.lit("2024-01-08")),
        until=F.to_timestamp(F.lit("2024-01-22")),
    )
    return plain(decode_events(part, schema_from_config(EXACT_ORDER), lineage=True))


@query(
    "pipeline_replay",
    f"""select window_start, window_start + interval '1 hour' window_end, event_type, {METRICS}
        from (select *, time_bucket(interval '1 hour', event_time) window_start from ({ORDERS})
              where arrival >= timestamp '2024-01-08' and arrival < timestamp '2024-01-22') group by window_start, event_type""",
)
def pipeline_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configured pipeline over two weeks of its file log, as a table."""
    folder = new_folder(spark, "replay")
    write_log(log_table(spark, sf_dir), folder)
    pipeline = EventPipeline(
        {
            "source": {"type": "files", "path": folder},
            "schema": EXACT_ORDER,
            "required": ["order_id", "event_time"],
            "processing": {"window_duration": "1 hour"},
        }
    )
    since, until = (F.to_timestamp(F.lit(day)) for day in ("2024-01-08", "2024-01-22"))
    return plain(pipeline.on_table(pipeline.log_table(spark, topics=["orders"], since=since, until=until)))


@query("dedup_events", f"select {PASSED}, arrival kafka_timestamp from ({ORDERS})")
def dedup_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = redelivered(events(spark, sf_dir)).drop("copy")
    return plain(deduplicate(copies, ["order_id"], first_by=["kafka_timestamp"]))


@query("dedup_stream", f"select {PASSED} from ({ORDERS})")
def dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies arrive in later micro-batches; between batches the stream restarts from its checkpoint."""
    work = new_folder(spark, "dedup")
    copies = redelivered(events(spark, sf_dir)).drop("kafka_timestamp")
    for folder in fed_in_turns(copies, "copy"):
        pipeline = EventPipeline(
            {
                "source": {"type": "events"},
                "dedup": ["order_id"],
                "watermark": {"delay": WHOLE_HISTORY},
                "processing": {"window_type": "none"},
                "output": {"type": "parquet", "path": f"{work}/out", "partition_by": None},
                "checkpoint": f"{work}/checkpoint",
                "trigger": AVAILABLE_NOW,
                "shuffle_partitions": cores(spark),
            }
        )
        pipeline.start(spark, spark.readStream.schema(copies.schema).parquet(folder))
        pipeline.await_all()
    return plain(spark.read.parquet(f"{work}/out").drop("copy"))


@query("dedup_beyond_watermark", f"select order_id, event_time, arrival kafka_timestamp from ({ORDERS})")
def dedup_beyond_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thirtieth event comes once more a week later, long after any watermark has passed it."""
    folder, source = new_folder(spark, "unique"), orders(spark, sf_dir)
    zoned = source.withColumns({name: F.col(name).cast("timestamp") for name in ("event_time", "kafka_timestamp")})
    again = zoned.where(F.col("order_id").cast("long") % 30 == 0).withColumn("kafka_timestamp", F.col("kafka_timestamp") + F.expr("interval 7 days"))
    both = zoned.unionByName(again)
    turns = both.withColumn("week", F.date_format(F.date_trunc("week", "kafka_timestamp"), "yyyy-MM-dd"))
    unique = UniqueEvents(folder, ["order_id"])
    for turn in fed_in_turns(turns, "week"):
        stream = spark.readStream.schema(turns.schema).parquet(turn).drop("week")
        run(table_sink(stream, unique.apply_batch, "append", f"{folder}-checkpoint"), AVAILABLE_NOW).awaitTermination()
    return plain(unique.read(spark).select("order_id", "event_time", "kafka_timestamp"))


@query("sink_console", "select count(*)::bigint rows_in, count(distinct date_trunc('day', ts))::bigint windows_out from events")
def sink_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A daily count on the console, by the configured pipeline: what its progress says of rows read and windows kept."""
    folder = new_folder(spark, "console")
    pipeline = EventPipeline(
        {
            "source": {"type": "events"},
            "processing": {"window_duration": "1 day", "group_by": [], "aggregations": {"event_count": "count(*)"}},
            "output": {"type": "console"},
            "checkpoint": f"{folder}/checkpoint",
            "trigger": AVAILABLE_NOW,
            "shuffle_partitions": cores(spark),
        }
    )
    stream = order_events(events_stream(spark, sf_dir))
    pipeline.start(spark, stream.withColumn("event_time", F.col("event_time").cast("timestamp")))
    pipeline.await_all()
    progress = pipeline.queries[-1].recentProgress
    rows = sum(batch["numInputRows"] for batch in progress)
    updated = sum(state["numRowsUpdated"] for batch in progress for state in batch["stateOperators"])
    return spark.createDataFrame([(rows, updated)], "rows_in bigint, windows_out bigint")


@query(
    "sink_parquet_roundtrip",
    f"""select *, strftime(window_start, '%Y-%m-%d') event_date from ({tumbling(METRICS, "15 minutes")})
        where window_end <= (select max(ts) - interval '10 minutes' from events)""",
)
def sink_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configured pipeline from a file log to a parquet folder partitioned by date."""
    folder = new_folder(spark, "sink")
    write_log(log_table(spark, sf_dir), f"{folder}/log")
    pipeline = EventPipeline(
        {
            "source": {"type": "files", "path": f"{folder}/log"},
            "schema": EXACT_ORDER,
            "required": ["order_id", "customer_id", "event_time"],
            "watermark": {"column": "event_time", "delay": "10 minutes"},
            "processing": {"window_type": "tumbling", "window_duration": "15 minutes"},
            "quarantine": {"path": f"{folder}/quarantine"},
            "output": {"type": "parquet", "path": f"{folder}/out"},
            "checkpoint": f"{folder}/checkpoint",
            "trigger": AVAILABLE_NOW,
            "shuffle_partitions": cores(spark),
        }
    )
    pipeline.start(spark)
    pipeline.await_all()
    written = spark.read.parquet(f"{folder}/out")
    return plain(written.withColumn("event_date", F.col("event_date").cast("string")))


@query("sink_upsert_final", tumbling(METRICS, "1 hour"))
def sink_upsert_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Update mode into an upserted table: windows of one week change again with the events that arrive later."""
    work = new_folder(spark, "upsert")
    source = orders(spark, sf_dir)
    weekly = source.withColumn("week", F.date_format(F.date_trunc("week", "kafka_timestamp"), "yyyy-MM-dd"))
    for folder in fed_in_turns(weekly, "week"):
        pipeline = EventPipeline(
            {
                "source": {"type": "events"},
                "watermark": {"delay": WHOLE_HISTORY},
                "processing": {"window_type": "tumbling", "window_duration": "1 hour"},
                "output": {"type": "table", "path": f"{work}/table"},
                "checkpoint": f"{work}/checkpoint",
                "trigger": AVAILABLE_NOW,
                "shuffle_partitions": cores(spark),
            }
        )
        pipeline.start(spark, spark.readStream.schema(weekly.schema).parquet(folder))
        pipeline.await_all()
    return plain(UpsertTable(f"{work}/table", ["window_start", "window_end", "event_type"]).read(spark))


@query("sink_upsert_restart", tumbling(METRICS, "1 hour"))
def sink_upsert_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table filled by a stream per week, each with a checkpoint of its own: batch numbers begin again every time.

    A week's stream is handed the events of all weeks up to then, so that its windows are whole.
    """
    work = new_folder(spark, "restart")
    source = orders(spark, sf_dir)
    weekly = source.withColumn("week", F.date_format(F.date_trunc("week", "kafka_timestamp"), "yyyy-MM-dd"))
    for turn, folder in enumerate(fed_in_turns(weekly, "week")):
        pipeline = EventPipeline(
            {
                "source": {"type": "events"},
                "watermark": {"delay": WHOLE_HISTORY},
                "processing": {"window_type": "tumbling", "window_duration": "1 hour"},
                "output": {"type": "table", "path": f"{work}/table"},
                "checkpoint": f"{work}/checkpoint-{turn}",
                "trigger": AVAILABLE_NOW,
                "shuffle_partitions": cores(spark),
            }
        )
        pipeline.start(spark, spark.readStream.schema(weekly.schema).parquet(folder))
        pipeline.await_all()
    return plain(pipeline.upserted().read(spark))


@query(
    "pipeline_required",
    f"""select event_type, count(*) event_count from ({ORDERS})
        where not (quantity < 25 and event_type in ('error', 'view', 'click', 'signup', 'purchase')) group by 1""",
)
def pipeline_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configured pipeline over a log with spoiled messages: what lacks a required field never comes through."""
    pipeline = EventPipeline(
        {
            "source": {"type": "files", "path": "handed over"},
            "schema": EXACT_ORDER,
            "required": ["order_id", "customer_id", "event_time"],
            "quarantine": {"bad_events": "drop"},
            "processing": {"window_type": "none"},
        }
    )
    good = pipeline.on_table(spoiled_log(events(spark, sf_dir)))
    return good.groupBy("event_type").agg(F.count(F.lit(1)).alias("event_count"))


@query(
    "window_kinds",
    f"""select 'tumbling' kind, count(*) windows, sum(n)::bigint events from ({tumbling("count(*) n", "1 hour")})
        union all select 'sliding', count(*), sum(n)::bigint from ({sliding("count(*) n", "1 hour", "15 minutes", 4)})
        union all select 'session', count(*), sum(n)::bigint from ({sessions("count(*) n", "30 minutes", "event_type")})
        union all select 'none', count(*), count(*) from events""",
)
def window_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of window chosen by configuration alone."""
    parts = []
    for kind in ("tumbling", "sliding", "session", "none"):
        pipeline = EventPipeline(
            {
                "source": {"type": "events"},
                "processing": {
                    "window_type": kind,
                    "window_duration": "1 hour",
                    "slide_duration": "15 minutes",
                    "session_gap": "30 minutes",
                    "aggregations": {"n": "count(*)"},
                },
            }
        )
        result = pipeline.on_table(orders(spark, sf_dir))
        number = F.sum("n") if kind != "none" else F.count(F.lit(1))
        parts.append(result.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("windows"), number.alias("events")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
