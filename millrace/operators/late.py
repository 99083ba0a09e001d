"""Late events: telling them apart on tables, describing and counting them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.durations import interval
from millrace.functions.folders import stored
from millrace.operators.broadcasts import join_lookup

LATE_REASON = "late_arrival"
WITHIN_MAX = "within_max"
BEYOND_MAX = "beyond_max"


def batch_watermarks(
    df: DataFrame, batch_column: str, *, time_column: str = "event_time", delay: str = "10 minutes"
) -> DataFrame:
    """The watermark each micro-batch of a recorded log started with: one row per batch.

    Watermark of a batch = latest event time of all earlier batches, less the delay; null before the first
    event time. Events are reduced to one row per batch first. The running maximum then goes over ranges of
    batches in parallel, and only one row per range is put in one order.
    """
    by_batch = df.groupBy(batch_column).agg(F.max(time_column).alias("__high"))
    # The range number must not change between uses, so it is stored and its lineage cut.
    ranges = stored(
        by_batch.where(F.col(batch_column).isNotNull())
        .repartitionByRange(batch_column)
        .withColumn("__range", F.spark_partition_id())
    )
    earlier = (Window.unboundedPreceding, -1)
    before_range = F.max("__top").over(Window.orderBy("__range").rowsBetween(*earlier))
    tops = ranges.groupBy("__range").agg(F.max("__high").alias("__top")).withColumn("__before", before_range)
    in_range = F.max("__high").over(Window.partitionBy("__range").orderBy(batch_column).rowsBetween(*earlier))
    return (
        ranges.join(tops, "__range")
        .select(batch_column, (F.greatest(in_range, "__before") - interval(delay)).alias("watermark"))
    )


def mark_late(
    df: DataFrame,
    batch_column: str,
    *,
    time_column: str = "event_time",
    delay: str = "10 minutes",
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Add ``watermark`` and ``is_late`` to the events of a recorded log; every event is kept.

    The rule is that of the streaming router: an event is late if it is older than the watermark its batch
    started with. That is stricter than Spark's own filter, which drops by window end and one batch later, so
    an event found on time here is never dropped by the aggregate behind it.
    """
    marks = stored(batch_watermarks(df, batch_column, time_column=time_column, delay=delay))
    joined = join_lookup(df, marks, [batch_column], rows=marks.count(), limit=broadcast_rows)
    late = F.coalesce(F.col(time_column) < F.col("watermark"), F.lit(False))
    return joined.select(*df.columns, "watermark", late.alias("is_late"))


def split_late(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The on-time and the late events of ``mark_late``."""
    return marked.where(~F.col("is_late")), marked.where("is_late")


def with_late_metadata(df: DataFrame, *, reason: str = LATE_REASON, routed_at: Column | None = None) -> DataFrame:
    """Add the ``_late_metadata`` struct of the side output."""
    at = F.current_timestamp() if routed_at is None else routed_at
    return df.withColumn("_late_metadata", F.struct(at.alias("routed_at"), F.lit(reason).alias("reason")))


def with_lateness(
    df: DataFrame, *, time_column: str = "event_time", arrival_column: str = "kafka_timestamp"
) -> DataFrame:
    """Add ``arrival_time`` and ``lateness_seconds``, the whole seconds from event to arrival."""
    seconds = F.timestamp_diff("SECOND", F.col(time_column), F.col(arrival_column))
    return df.withColumn("arrival_time", F.col(arrival_column)).withColumn("lateness_seconds", seconds)


def classify_lateness(
    df: DataFrame,
    max_lateness: str = "1 hour",
    *,
    time_column: str = "event_time",
    arrival_column: str = "arrival_time",
) -> DataFrame:
    """Add ``lateness_class``; events beyond the maximum are named so, not removed."""
    within = F.col(arrival_column) <= F.col(time_column) + interval(max_lateness)
    return df.withColumn("lateness_class", F.when(within, WITHIN_MAX).otherwise(BEYOND_MAX))


def enrich_late(
    df: DataFrame,
    *,
    time_column: str = "event_time",
    arrival_column: str = "kafka_timestamp",
    max_lateness: str = "1 hour",
    reason: str = LATE_REASON,
) -> DataFrame:
    """Everything the side output says about a late event."""
    timed = with_lateness(df, time_column=time_column, arrival_column=arrival_column)
    return with_late_metadata(classify_lateness(timed, max_lateness, time_column=time_column), reason=reason)


def lateness_profile(df: DataFrame, *group_by: str, late_column: str = "is_late") -> DataFrame:
    """Events, late events, their share, and least, most and mean lateness of the late ones, per group."""
    late_seconds = F.when(F.col(late_column), F.col("lateness_seconds"))
    late = F.count_if(F.col(late_column))
    return df.groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("event_count"),
        late.alias("late_count"),
        (late / F.count(F.lit(1))).alias("late_share"),
        F.min(late_seconds).alias("min_lateness_seconds"),
        F.max(late_seconds).alias("max_lateness_seconds"),
        F.avg(late_seconds).alias("avg_lateness_seconds"),
    )
