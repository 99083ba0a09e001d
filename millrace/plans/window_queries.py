"""Queries for windows and aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.folders import new_folder
from millrace.functions.measures import ORDER_METRICS
from millrace.operators.windows import EventWindow, aggregate_windows, with_event_date
from millrace.plans.pipeline import EventPipeline
from millrace.plans.registry import query
from millrace.sources.tables import events, events_stream, order_events
from millrace.streaming.triggers import AVAILABLE_NOW

# Order events in SQL; prices are decimals, so sums are exact.
ORDERS = """
  select cast(event_id as varchar) order_id, cast(user_id as varchar) customer_id,
         cast(event_id % 500 as varchar) product_id,
         cast(regexp_extract(props, '"k": *([0-9]+)', 1) as int) quantity,
         cast(value as decimal(12,2)) unit_price, ts event_time, event_type,
         ts + to_minutes(cast(case when event_id % 20 = 0 then (event_id * 7) % 180 + 1 else 0 end as int)) arrival
  from events"""
EPOCH = "timestamp '1970-01-01'"


def average(column: str) -> str:
    """The mean of a positive decimal(12,2) column, rounded half up to six places in whole numbers."""
    cents = f"cast(sum({column}) * 100 as hugeint)"
    return f"cast(({cents} * 20000 + count({column})) // (2 * count({column})) as double) / 1000000"


def tumbling(columns: str, width: str = "1 hour", keys: str = "event_type", having: str = "") -> str:
    """Tumbling windows in SQL."""
    start = f"time_bucket(interval '{width}', event_time, {EPOCH})"
    names = f", {keys}" if keys else ""
    return (
        f"select {start} window_start, {start} + interval '{width}' window_end{names}, {columns} "
        f"from ({ORDERS}) group by {start}{names} {having}"
    )


def sliding(columns: str, width: str, slide: str, steps: int, keys: str = "event_type") -> str:
    """Sliding windows in SQL: each event in every window start of the last ``steps`` slides that reaches it."""
    return f"""
      select s window_start, s + interval '{width}' window_end, {keys}, {columns}
      from (select *, time_bucket(interval '{slide}', event_time, {EPOCH}) - i * interval '{slide}' s
            from ({ORDERS}), range({steps}) t(i))
      where event_time < s + interval '{width}' group by s, {keys}"""


def sessions(columns: str, gap: str, keys: str = "customer_id", source: str = ORDERS) -> str:
    """Sessions in SQL."""
    over = f"over (partition by {keys} order by event_time" if keys else "over (order by event_time"
    names = f"{keys}, " if keys else ""
    return f"""
      select min(event_time) window_start, max(event_time) + interval '{gap}' window_end, {names}{columns}
      from (select *, sum(opens) {over} rows unbounded preceding) session
            from (select *, case when event_time - lag(event_time) {over}) <= interval '{gap}'
                                 then 0 else 1 end opens from ({source})))
      group by {names}session"""


METRICS = f"count(*) event_count, sum(quantity)::bigint total_quantity, {average('unit_price')} avg_price"
HOUR = EventWindow("tumbling", "1 hour")
# Spec and SQL column of one measure per aggregate function.
SINGLE_MEASURES = {
    "agg_count": ({"n": "count(*)", "n_price": "count(unit_price)"}, "count(*) n, count(unit_price) n_price"),
    "agg_sum": ({"quantity_sum": "sum(quantity)"}, "sum(quantity)::bigint quantity_sum"),
    "agg_avg": ({"avg_price": "avg(unit_price)"}, f"{average('unit_price')} avg_price"),
    "agg_min": ({"min_price": "min(unit_price)"}, "min(unit_price)::double min_price"),
    "agg_max": ({"max_price": "max(unit_price)"}, "max(unit_price)::double max_price"),
    "agg_default": (None, "count(*) event_count"),
}
ALL_MEASURES = {
    "n": "count(*)",
    "quantity_sum": "sum(quantity)",
    "price_sum": "sum(unit_price)",
    "quantity_avg": "avg(quantity)",
    "avg_price": "avg(unit_price)",
    "lo": "min(unit_price)",
    "hi": "max(unit_price)",
}
ALL_COLUMNS = (
    "count(*) n, sum(quantity)::bigint quantity_sum, sum(unit_price)::double price_sum, avg(quantity) quantity_avg, "
    f"{average('unit_price')} avg_price, min(unit_price)::double lo, max(unit_price)::double hi"
)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_events(events(spark, sf_dir))


def cores(spark: SparkSession) -> int:
    """State partitions of a stream: one per core of the cluster."""
    return spark.sparkContext.defaultParallelism


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and zoned timestamps as UTC wall time, to compare with SQL."""
    casts = {
        field.name: F.col(field.name).cast("double" if "decimal" in field.dataType.typeName() else "timestamp_ntz")
        for field in df.schema.fields
        if field.dataType.typeName() in ("decimal", "timestamp")
    }
    return df.withColumns(casts) if casts else df


def _register(
    name: str,
    sql: str,
    window: EventWindow,
    group_by: Sequence[str],
    aggregations: Mapping[str, str] | None,
) -> None:
    @query(name, sql)
    def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
        result = aggregate_windows(orders(spark, sf_dir), window, group_by=group_by, aggregations=aggregations)
        return plain(result)


for _name, (_spec, _columns) in SINGLE_MEASURES.items():
    _register(_name, tumbling(_columns), HOUR, ["event_type"], _spec)

_register(
    "agg_spec_multi",
    tumbling(ALL_COLUMNS, "1 day"),
    EventWindow("tumbling", "1 day"),
    ["event_type"],
    ALL_MEASURES,
)
_register(
    "rolling_prefix",
    sliding(ALL_COLUMNS, "1 hour", "1 minute", 60),
    EventWindow("sliding", "1 hour", "1 minute"),
    ["event_type"],
    ALL_MEASURES,
)
_register(
    "group_multi_key",
    tumbling(METRICS, "1 hour", "event_type, customer_id"),
    HOUR,
    ["event_type", "customer_id"],
    ORDER_METRICS,
)
_register("window_tumbling", tumbling(METRICS, "7 minutes", ""), EventWindow("tumbling", "7 minutes"), [], ORDER_METRICS)
_register(
    "window_sliding",
    sliding("count(*) event_count", "1 hour", "15 minutes", 4),
    EventWindow("sliding", "1 hour", "15 minutes"),
    ["event_type"],
    None,
)
_register(
    "window_sliding_uneven",
    sliding(ALL_COLUMNS, "50 minutes", "20 minutes", 3),
    EventWindow("sliding", "50 minutes", "20 minutes"),
    ["event_type"],
    ALL_MEASURES,
)
_register(
    "window_session",
    sessions(ALL_COLUMNS, "30 minutes"),
    EventWindow("session", gap="30 minutes"),
    ["customer_id"],
    ALL_MEASURES,
)
_register(
    "window_session_global",
    sessions("count(*) event_count", "5 minutes", ""),
    EventWindow("session", gap="5 minutes"),
    [],
    None,
)
_register(
    "rolling_avg",
    sliding(f"{average('unit_price')} avg_price", "1 hour", "1 minute", 60),
    EventWindow("sliding", "1 hour", "1 minute"),
    ["event_type"],
    {"avg_price": "avg(unit_price)"},
)

PASSED = "order_id, customer_id, product_id, quantity, unit_price::double unit_price, event_time, event_type"


@query("passthrough", f"select {PASSED} from ({ORDERS})")
def passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = aggregate_windows(orders(spark, sf_dir), EventWindow("none"))
    return plain(result.drop("kafka_timestamp"))


def preset(window_type: str, duration: str, slide: str | None = None) -> EventPipeline:
    """A pipeline of the order metrics over events handed to it."""
    processing = {"window_type": window_type, "window_duration": duration}
    if slide is not None:
        processing["slide_duration"] = slide
    return EventPipeline({"source": {"type": "events"}, "processing": processing})


@query("order_metrics_tumbling", tumbling(METRICS, "5 minutes"))
def order_metrics_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(preset("tumbling", "5 minutes").on_table(orders(spark, sf_dir)))


@query("order_metrics_sliding", sliding(METRICS, "5 minutes", "1 minute", 5))
def order_metrics_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(preset("sliding", "5 minutes", "1 minute").on_table(orders(spark, sf_dir)))


@query(
    "closed_windows",
    f"select * from ({tumbling(METRICS)}) "
    "where window_end <= (select max(ts) - interval '10 minutes' from events)",
)
def closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream form, append mode: the windows the watermark has closed at the end of the data."""
    folder = new_folder(spark, "closed")
    pipeline = EventPipeline(
        {
            "source": {"type": "events"},
            "processing": {"window_type": "tumbling", "window_duration": "1 hour"},
            "output": {"type": "parquet", "path": f"{folder}/out", "partition_by": None},
            "checkpoint": f"{folder}/checkpoint",
            "trigger": AVAILABLE_NOW,
            "shuffle_partitions": cores(spark),
        }
    )
    pipeline.start(spark, order_events(events_stream(spark, sf_dir)))
    pipeline.await_all()
    return plain(spark.read.parquet(f"{folder}/out"))


@query(
    "event_dates",
    f"select *, strftime(window_start, '%Y-%m-%d') event_date from ({tumbling('count(*) event_count')})",
)
def event_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window results with the column file sinks partition by."""
    dated = with_event_date(aggregate_windows(orders(spark, sf_dir), HOUR, group_by=["event_type"]))
    return dated.withColumn("event_date", F.col("event_date").cast("string"))
