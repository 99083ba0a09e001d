"""Queries for late events: splitting, describing, reprocessing, and the router on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.folders import new_folder
from millrace.functions.measures import ORDER_METRICS
from millrace.operators.decode import encode_events
from millrace.operators.late import enrich_late, lateness_profile, mark_late, split_late, with_lateness
from millrace.operators.quantiles import pane_sketches, window_quantiles
from millrace.operators.reprocess import reprocess, reprocess_sessions, touched_windows
from millrace.operators.windows import EventWindow
from millrace.plans.config import PipelineConfig
from millrace.plans.pipeline import EventPipeline, query_settings, session_settings
from millrace.plans.registry import query
from millrace.plans.window_queries import (
    HOUR,
    METRICS,
    ORDERS,
    average,
    cores,
    orders,
    plain,
    sessions,
    sliding,
    tumbling,
)
from millrace.sources.tables import EVENTS_OF_A_TASK, dealt, events, events_stream, fed_in_turns, order_events
from millrace.streaming.router import LATE, ON_TIME, QUARANTINE, LateRouter
from millrace.streaming.sessions import apply_session_changes, session_changes
from millrace.streaming.sinks import run, table_sink
from millrace.streaming.triggers import AVAILABLE_NOW
from millrace.streaming.upsert import UpsertTable


def marked(batch: str = "hour", source: str = ORDERS) -> str:
    """Order events in SQL with the watermark of their micro-batch (one per hour of arrival)."""
    return f"""
      select o.*, wm, coalesce(event_time < wm, false) is_late, date_diff('second', event_time, arrival) lateness_seconds
      from (select *, date_trunc('{batch}', arrival) batch from ({source})) o
      join (select date_trunc('{batch}', arrival) batch,
                   max(max(event_time)) over (order by date_trunc('{batch}', arrival)
                                              rows between unbounded preceding and 1 preceding)
                   - interval 10 minutes wm
            from ({source}) group by 1) using (batch)"""


LATE_ORDERS = f"select * from ({marked()}) where is_late"
ON_TIME_ORDERS = f"select * from ({marked()}) where not is_late"
SESSION = EventWindow("session", gap="30 minutes")
TOUCHED = "count(*) event_count, sum(quantity)::bigint total_quantity"
TOUCHED_SPEC = {"event_count": "count(*)", "total_quantity": "sum(quantity)"}


def marked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = orders(spark, sf_dir)
    return mark_late(source.withColumn("batch", F.date_trunc("hour", "kafka_timestamp")), "batch")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return split_late(marked_orders(spark, sf_dir))


@query(
    "late_split",
    f"select order_id, case when is_late then 'late' else 'on_time' end side, lateness_seconds from ({marked()})",
)
def late_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("is_late"), "late").otherwise("on_time").alias("side")
    return with_lateness(marked_orders(spark, sf_dir)).select("order_id", side, "lateness_seconds")


@query(
    "late_enrich",
    f"""select order_id, event_time, arrival arrival_time, lateness_seconds, 'late_arrival' reason,
          'known' routed_at from ({LATE_ORDERS})""",
)
def late_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, late = sides(spark, sf_dir)
    metadata = F.col("_late_metadata")
    return enrich_late(late).select(
        "order_id",
        "event_time",
        "arrival_time",
        "lateness_seconds",
        metadata["reason"].alias("reason"),
        F.when(metadata["routed_at"].isNotNull(), "known").alias("routed_at"),
    )


@query(
    "late_classes",
    f"""select case when arrival <= event_time + interval '1 hour' then 'within_max' else 'beyond_max' end lateness_class,
          count(*) event_count from ({LATE_ORDERS}) group by 1""",
)
def late_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, late = sides(spark, sf_dir)
    return enrich_late(late).groupBy("lateness_class").agg(F.count(F.lit(1)).alias("event_count"))


@query(
    "late_reprocess",
    f"""select * from ({tumbling(METRICS)}) semi join
          (select distinct time_bucket(interval '1 hour', event_time) window_start, event_type from ({LATE_ORDERS}))
        using (window_start, event_type)""",
)
def late_reprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_time, late = sides(spark, sf_dir)
    return plain(reprocess(on_time, late, HOUR, group_by=["event_type"], aggregations=ORDER_METRICS))


@query(
    "late_touched_windows",
    f"""select * from ({tumbling(METRICS)}) semi join
          (select distinct time_bucket(interval '1 hour', event_time) window_start, event_type from ({LATE_ORDERS}))
        using (window_start, event_type)""",
)
def late_touched_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same windows from a table that holds both sides, in one aggregate."""
    marked_rows = marked_orders(spark, sf_dir)
    return plain(touched_windows(marked_rows, HOUR, group_by=["event_type"], aggregations=ORDER_METRICS))


@query(
    "late_reprocess_sliding",
    f"""select * from ({sliding(TOUCHED, "1 hour", "15 minutes", 4)}) semi join
          (select distinct time_bucket(interval '15 minutes', event_time) - i * interval '15 minutes' window_start,
                  event_type from ({LATE_ORDERS}), range(4) t(i))
        using (window_start, event_type)""",
)
def late_reprocess_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_time, late = sides(spark, sf_dir)
    window = EventWindow("sliding", "1 hour", "15 minutes")
    return plain(reprocess(on_time, late, window, group_by=["event_type"], aggregations=TOUCHED_SPEC))


_SESSIONS_WITH_LATE = sessions(f"{TOUCHED}, bool_or(is_late) touched", "30 minutes", source=marked())


@query(
    "late_reprocess_sessions",
    f"select * exclude (touched) from ({_SESSIONS_WITH_LATE}) where touched",
)
def late_reprocess_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_time, late = sides(spark, sf_dir)
    new, _ = reprocess_sessions(on_time, late, SESSION, group_by=["customer_id"], aggregations=TOUCHED_SPEC)
    return plain(new)


@query(
    "late_stale_sessions",
    f"""select o.window_start, o.window_end, o.customer_id
        from ({sessions("count(*) n", "30 minutes", source=ON_TIME_ORDERS)}) o
        join ({_SESSIONS_WITH_LATE}) n
          on o.customer_id = n.customer_id and n.touched
         and o.window_start >= n.window_start and o.window_end <= n.window_end
        where o.window_start <> n.window_start or o.window_end <> n.window_end""",
)
def late_stale_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_time, late = sides(spark, sf_dir)
    return reprocess_sessions(on_time, late, SESSION, group_by=["customer_id"])[1]


@query(
    "lateness_profile",
    f"""select event_type, count(*) event_count, count(*) filter (is_late) late_count,
          (count(*) filter (is_late)) / count(*) late_share,
          coalesce(min(lateness_seconds) filter (is_late), -1) min_lateness_seconds,
          coalesce(max(lateness_seconds) filter (is_late), -1) max_lateness_seconds,
          coalesce(avg(lateness_seconds) filter (is_late), -1) avg_lateness_seconds
        from ({marked()}) group by event_type""",
)
def late_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = lateness_profile(with_lateness(marked_orders(spark, sf_dir)), "event_type")
    return profile.fillna(-1)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order events with zoned times and the week they arrived in, to be fed as one micro-batch per week."""
    source = order_events(dealt(events(spark, sf_dir), "event_id", each=EVENTS_OF_A_TASK))
    zoned = source.withColumns({name: F.col(name).cast("timestamp") for name in ("event_time", "kafka_timestamp")})
    return zoned.withColumn("week", F.date_format(F.date_trunc("week", "kafka_timestamp"), "yyyy-MM-dd"))


@query(
    "late_router",
    f"""select order_id, case when is_late then 'late' else 'on_time' end side,
          case when is_late then lateness_seconds else -1 end lateness_seconds,
          case when not is_late then '' when arrival <= event_time + interval '1 hour' then 'within_max'
               else 'beyond_max' end lateness_class
        from ({marked("week")})""",
)
def late_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of the router on a stream, restarted after each micro-batch: together all events, none twice."""
    source = weekly(spark, sf_dir)
    router = LateRouter(new_folder(spark, "router"))
    for folder in fed_in_turns(source, "week"):
        router.start(spark.readStream.schema(source.schema).parquet(folder), AVAILABLE_NOW).awaitTermination()
    late = router.read_late(spark, source.schema).select(
        "order_id", F.lit(LATE).alias("side"), "lateness_seconds", "lateness_class"
    )
    on_time = router.read_on_time(spark, source.schema).select(
        "order_id",
        F.lit(ON_TIME).alias("side"),
        F.lit(-1).cast("long").alias("lateness_seconds"),
        F.lit("").alias("lateness_class"),
    )
    return on_time.unionByName(late)


_ROLLING = sliding(f"count(*) n, {average('unit_price')} avg_price", "1 hour", "1 minute", 60)


@query(
    "rolling_avg_stream",
    f"select * from ({_ROLLING}) where window_end <= (select max(ts) - interval '10 minutes' from events)",
)
def rolling_avg_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of an hour, every minute, on a stream behind the router: the windows closed at the end of the data."""
    work = new_folder(spark, "rolling")
    pipeline = EventPipeline(
        {
            "source": {"type": "events"},
            "processing": {
                "window_type": "sliding",
                "window_duration": "1 hour",
                "slide_duration": "1 minute",
                "aggregations": {"n": "count(*)", "avg_price": "avg(unit_price)"},
                "panes": True,
            },
            "late": {"path": f"{work}/routed"},
            "output": {"type": "parquet", "path": f"{work}/out", "partition_by": None},
            "checkpoint": f"{work}/checkpoint",
            "trigger": AVAILABLE_NOW,
            "shuffle_partitions": cores(spark),
        }
    )
    stream = order_events(events_stream(spark, sf_dir))
    zoned = stream.withColumns({name: F.col(name).cast("timestamp") for name in ("event_time", "kafka_timestamp")})
    pipeline.start(spark, zoned)
    pipeline.await_all()
    return plain(spark.read.parquet(f"{work}/out"))


@query("late_sessions_stream", sessions("count(*) event_count, sum(quantity)::bigint total_quantity", "30 minutes"))
def late_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream that late events lengthen and join as they come: equal to those of all events at once."""
    work, source = new_folder(spark, "sessions"), weekly(spark, sf_dir)
    table = UpsertTable(f"{work}/table", ["window_start", "window_end", "customer_id"])
    settings = session_settings(PipelineConfig.from_dict({"source": {"type": "events"}, "shuffle_partitions": cores(spark)}))
    for folder in fed_in_turns(source, "week"):
        events = spark.readStream.schema(source.schema).parquet(folder)
        changed = session_changes(events, "30 minutes", group_by=["customer_id"], aggregations=TOUCHED_SPEC, horizon="3650 days")
        with query_settings(spark, settings):
            run(table_sink(changed, apply_session_changes(table), "update", f"{work}/checkpoint"), AVAILABLE_NOW).awaitTermination()
    return plain(table.read(spark))


@query("open_windows_state", tumbling(METRICS))
def open_windows_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that a stream has closed, from its sink, and those it holds open, from its state: all there are."""
    work, source = new_folder(spark, "open"), weekly(spark, sf_dir)
    pipeline = EventPipeline(
        {
            "source": {"type": "events"},
            "processing": {"window_type": "tumbling", "window_duration": "1 hour"},
            # No event of this table is further behind the others than its delay.
            "watermark": {"delay": "4 hours"},
            "output": {"type": "parquet", "path": f"{work}/out", "partition_by": None},
            "checkpoint": f"{work}/checkpoint",
            "trigger": AVAILABLE_NOW,
            "shuffle_partitions": cores(spark),
        }
    )
    for folder in fed_in_turns(source, "week"):
        pipeline.start(spark, spark.readStream.schema(source.schema).parquet(folder))
        pipeline.await_all()
    return plain(spark.read.parquet(f"{work}/out").unionByName(pipeline.open_windows(spark, source)))


@query(
    "lateness_quantiles",
    f"""select date_trunc('day', event_time) window_start, date_trunc('day', event_time) + interval 1 day window_end, event_type,
          count(*) n, quantile_disc(lateness_seconds, 0.5)::bigint p50, quantile_disc(lateness_seconds, 0.95)::bigint p95,
          quantile_disc(lateness_seconds, 0.99)::bigint p99 from ({marked()}) where is_late group by all""",
)
def lateness_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How late the late events of a day are, from sketches of each hour."""
    late = with_lateness(split_late(marked_orders(spark, sf_dir))[1])
    sketches = pane_sketches(late, "lateness_seconds", "1 hour", group_by=["event_type"])
    return plain(window_quantiles(sketches, EventWindow("tumbling", "1 day"), "1 hour", group_by=["event_type"]))


@query("late_router_complete", tumbling(METRICS))
def late_router_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows from the on-time log, corrected by reprocessing the side output: equal to all events at once."""
    work, source = new_folder(spark, "complete"), weekly(spark, sf_dir)
    pipeline = EventPipeline(
        {
            "source": {"type": "events"},
            "processing": {"window_type": "tumbling", "window_duration": "1 hour"},
            "late": {"path": f"{work}/routed", "max_lateness": "1 hour"},
            "output": {"type": "table", "path": f"{work}/table"},
            "checkpoint": f"{work}/checkpoint",
            "trigger": AVAILABLE_NOW,
            "shuffle_partitions": cores(spark),
        }
    )
    for folder in fed_in_turns(source, "week"):
        pipeline.start(spark, spark.readStream.schema(source.schema).parquet(folder))
        pipeline.await_all()
    pipeline.correct(spark, source.schema)
    return plain(pipeline.upserted().read(spark))


@query("late_router_corrections", tumbling(METRICS))
def late_router_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected while the stream goes on, which writes open windows again without their late events, and at the end."""
    work, source = new_folder(spark, "corrections"), weekly(spark, sf_dir)
    pipeline = EventPipeline(
        {
            "source": {"type": "events"},
            "processing": {"window_type": "tumbling", "window_duration": "1 hour"},
            "late": {"path": f"{work}/routed"},
            "output": {"type": "table", "path": f"{work}/table"},
            "checkpoint": f"{work}/checkpoint",
            "trigger": AVAILABLE_NOW,
            "shuffle_partitions": cores(spark),
        }
    )
    for turn, folder in enumerate(fed_in_turns(source, "week")):
        pipeline.start(spark, spark.readStream.schema(source.schema).parquet(folder))
        pipeline.await_all()
        if turn in (1, 2):
            pipeline.correct(spark, source.schema)
    pipeline.correct(spark, source.schema)
    return plain(pipeline.upserted().read(spark))


WRONG_CLOCK = 400


@query(
    "late_router_future",
    f"""select order_id, case when is_late then 'late' else 'on_time' end side, '' reason
        from ({marked("week", f"select * from ({ORDERS}) where order_id::bigint % {WRONG_CLOCK} <> 7")})
        union all select order_id, 'quarantine', 'future_time' from ({ORDERS}) where order_id::bigint % {WRONG_CLOCK} = 7""",
)
def late_router_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some events come from a clock seventy years ahead: they go to quarantine, and no other event becomes late by them."""
    source = weekly(spark, sf_dir)
    wrong = F.col("order_id").cast("long") % WRONG_CLOCK == 7
    ahead = F.when(wrong, F.col("event_time") + F.expr("interval 70 years")).otherwise(F.col("event_time"))
    source = source.withColumn("event_time", ahead)
    router = LateRouter(new_folder(spark, "future"))
    for folder in fed_in_turns(source, "week"):
        router.start(spark.readStream.schema(source.schema).parquet(folder), AVAILABLE_NOW).awaitTermination()
    read = {ON_TIME: router.read_on_time, LATE: router.read_late, QUARANTINE: router.read_quarantine}
    sides = [
        rows(spark, source.schema).select(
            "order_id", F.lit(side).alias("side"), F.col("quarantine_reason").alias("reason") if side == QUARANTINE else F.lit("").alias("reason")
        )
        for side, rows in read.items()
    ]
    return sides[0].unionByName(sides[1]).unionByName(sides[2])


_WEEKLY_SESSIONS = sessions("count(*) event_count, bool_or(is_late) touched", "30 minutes", source=marked("week"))


@query(
    "late_sessions_complete",
    f"""select * exclude (touched) from ({_WEEKLY_SESSIONS})
        where touched or window_end <= (select max(ts) - interval 10 minutes from events)""",
)
def late_sessions_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions of the on-time log, corrected by the side output: joined ones deleted, longer ones added."""
    work, source = new_folder(spark, "sessions"), weekly(spark, sf_dir)
    pipeline = EventPipeline(
        {
            "source": {"type": "events"},
            "processing": {
                "window_type": "session",
                "session_gap": "30 minutes",
                "group_by": ["customer_id"],
                "aggregations": {"event_count": "count(*)"},
            },
            "late": {"path": f"{work}/routed"},
            "output": {"type": "table", "path": f"{work}/table"},
            "checkpoint": f"{work}/checkpoint",
            "trigger": AVAILABLE_NOW,
            "shuffle_partitions": cores(spark),
        }
    )
    for folder in fed_in_turns(source, "week"):
        pipeline.start(spark, spark.readStream.schema(source.schema).parquet(folder))
        pipeline.await_all()
    pipeline.correct(spark, source.schema)
    return plain(pipeline.upserted().read(spark))


def hourly(source: str) -> str:
    """Order metrics per hour and event type in SQL."""
    start = "time_bucket(interval '1 hour', event_time)"
    return f"select {start} window_start, {start} + interval '1 hour' window_end, event_type, {METRICS} from ({source}) group by all"


@query("late_router_backlog", hourly(f"select * from ({marked('week')}) where not is_late"))
def late_router_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All weeks are routed first; the windows then read them one batch at a time and lose nothing."""
    work, source = new_folder(spark, "backlog"), weekly(spark, sf_dir)
    pipeline = EventPipeline(
        {
            "source": {"type": "events"},
            "processing": {"window_type": "tumbling", "window_duration": "1 hour"},
            "late": {"path": f"{work}/routed", "max_batches": 1},
            "output": {"type": "table", "path": f"{work}/table"},
            "checkpoint": f"{work}/checkpoint",
            "trigger": AVAILABLE_NOW,
            "shuffle_partitions": cores(spark),
        }
    )
    for folder in fed_in_turns(source, "week"):
        log = spark.readStream.schema(source.schema).parquet(folder)
        pipeline.router().start(log, AVAILABLE_NOW).awaitTermination()
    pipeline.start(spark, spark.readStream.schema(source.schema).parquet(folder))
    pipeline.await_all()
    return plain(pipeline.upserted().read(spark))


@query(
    "stream_late_dropped",
    f"""select * from ({hourly(f"""
          select * from ({marked("week")})
          where wm is null or time_bucket(interval '1 hour', event_time) + interval '1 hour' > wm""")})
        where window_end <= (select max(ts) - interval 10 minutes from events)""",
)
def stream_late_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream without the router: Spark drops the events of windows that the watermark has closed."""
    work, source = new_folder(spark, "dropped"), weekly(spark, sf_dir)
    for folder in fed_in_turns(source, "week"):
        pipeline = EventPipeline(
            {
                "source": {"type": "events"},
                "processing": {"window_type": "tumbling", "window_duration": "1 hour"},
                "output": {"type": "parquet", "path": f"{work}/out", "partition_by": None},
                "checkpoint": f"{work}/checkpoint",
                "trigger": AVAILABLE_NOW,
                "shuffle_partitions": cores(spark),
            }
        )
        pipeline.start(spark, spark.readStream.schema(source.schema).parquet(folder))
        pipeline.await_all()
    return plain(spark.read.parquet(f"{work}/out"))


@query(
    "late_messages",
    f"""select order_id, order_id "key", lateness_seconds, 'late_arrival' reason,
          case when arrival <= event_time + interval '1 hour' then 'within_max' else 'beyond_max' end lateness_class
        from ({LATE_ORDERS})""",
)
def late_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages for a topic of late events, decoded again."""
    _, late = sides(spark, sf_dir)
    schema = "order_id string, lateness_seconds bigint, lateness_class string, _late_metadata struct<reason: string>"
    read = encode_events(enrich_late(late), "order_id").select("key", F.from_json("value", schema).alias("e"))
    return read.select("e.order_id", "key", "e.lateness_seconds", "e._late_metadata.reason", "e.lateness_class")
