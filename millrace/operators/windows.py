"""Event-time windows and the aggregates over them, the same for tables and streams."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.durations import as_text, interval_micros, to_micros
from millrace.functions.folders import stored
from millrace.functions.measures import Measure, column_type, measure_types, parse_measures

KINDS = ("tumbling", "sliding", "session", "none")
# Windows over more panes than this are put together from parts of blocks, not from panes.
EXPANDED_PANES = 6
# The partition column of event logs: the date of the event time in UTC.
DATE_COLUMN = "utc_date"


@dataclass(frozen=True)
class EventWindow:
    """The window of an aggregate.

    ``duration`` counts for tumbling and sliding windows, ``slide`` (by default the duration) for sliding
    ones, ``gap`` for sessions. ``none`` passes rows through.
    """

    kind: str = "tumbling"
    duration: str = "5 minutes"
    slide: str | None = None
    gap: str = "5 minutes"

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown window kind {self.kind!r}; one of {', '.join(KINDS)}")
        if self.kind == "session":
            to_micros(self.gap)
        elif self.kind != "none" and self.slide_micros > to_micros(self.duration):
            raise ValueError("the slide may not be longer than the window")

    @property
    def slide_micros(self) -> int:
        return to_micros(self.slide if self.kind == "sliding" and self.slide else self.duration)

    def column(self, time: Column) -> Column:
        """Spark's own window expression."""
        if self.kind == "session":
            return F.session_window(time, as_text(to_micros(self.gap)))
        if self.kind == "none":
            raise ValueError("a pass-through has no window")
        duration = as_text(to_micros(self.duration))
        return F.window(time, duration, as_text(self.slide_micros))


def with_event_watermark(df: DataFrame, column: str = "event_time", delay: str = "10 minutes") -> DataFrame:
    """Set the watermark of a stream; a table has none and is returned as is.

    Spark allows one watermark per query, so none of the other operators sets one. A stream cannot put a
    watermark on TIMESTAMP_NTZ; such a column is read as UTC wall time, whatever the session's zone is.
    """
    to_micros(delay)
    if not df.isStreaming:
        return df
    if column_type(df, column).typeName() == "timestamp_ntz":
        df = df.withColumn(column, utc_instant(F.col(column)))
    return df.withWatermark(column, delay)


def aggregate_windows(
    df: DataFrame,
    window: EventWindow,
    *,
    time_column: str = "event_time",
    group_by: Sequence[str] = (),
    aggregations: Mapping[str, str] | None = None,
    stream_panes: bool = False,
) -> DataFrame:
    """Aggregate per window and ``group_by`` columns.

    Result columns: ``window_start, window_end``, the keys, the measures. Rows without an event time belong
    to no window. Streams use Spark's stateful window operators. Tables take a two-step form for sliding and
    session windows, with equal results: raw rows are first combined, map side and then by key and slot, so
    that neither the sliding expansion nor a hot key's sessions are worked out on raw rows.

    ``stream_panes`` gives sliding windows of a stream the two-step form as well. Rows and state then are not
    multiplied by duration/slide. It needs append mode, and a row is late once its pane, not its window, is closed:
    use it behind the late router, where no row is late.
    """
    if window.kind == "none":
        return df
    keys = list(group_by)
    measures = parse_measures(aggregations)
    clash = {m.name for m in measures} & {*keys, "window_start", "window_end"}
    if clash or len(set(keys)) != len(keys):
        raise ValueError(f"result column names repeat: {sorted(clash) or keys}")
    if df.isStreaming:
        if window.kind == "session" and not keys:
            raise ValueError("sessions of a stream need at least one group_by column")
        if stream_panes and window.kind == "sliding":
            return _sliding_stream(df, window, time_column, keys, measures)
        return _native(df, window, time_column, keys, measures)
    if window.kind == "session":
        return _sessions(df, window, time_column, keys, measures)
    if window.slide_micros < to_micros(window.duration):
        return _sliding(df, window, time_column, keys, measures)
    return _native(df, window, time_column, keys, measures)


def _native(
    df: DataFrame, window: EventWindow, time_column: str, keys: list[str], measures: list[Measure]
) -> DataFrame:
    grouped = df.groupBy(window.column(F.col(time_column)).alias("__window"), *keys)
    return _flat(grouped.agg(*[m.whole() for m in measures]), keys, measures)


def _sliding(
    df: DataFrame, window: EventWindow, time_column: str, keys: list[str], measures: list[Measure]
) -> DataFrame:
    """Aggregate to panes first, then expand panes instead of rows.

    The pane is the widest slot that divides both slide and duration, so every window is a whole number of
    panes. At one hour every minute a raw row would otherwise become 60 rows before any aggregation.
    """
    duration, slide = to_micros(window.duration), window.slide_micros
    pane = math.gcd(slide, duration)
    types = measure_types(df, measures)
    panes = df.groupBy(F.window(time_column, as_text(pane)).alias("__pane"), *keys).agg(
        *[part for m in measures for part in m.partials(df)]
    )
    if duration // pane > EXPANDED_PANES:
        return _from_blocks(panes, duration, slide, keys, measures, types)
    at = F.col("__pane.start")
    newest = at if pane == slide else F.window(at, as_text(slide))["start"]
    # Every window start from the newest one back to, but without, one whole duration before the pane.
    starts = F.sequence(F.col("__newest"), at - interval_micros(duration - 1), -interval_micros(slide))
    result = (
        panes.withColumn("__newest", newest)
        .withColumn("window_start", F.explode(starts))
        .groupBy("window_start", *keys)
        .agg(*[m.combined(types) for m in measures])
        .withColumn("window_end", F.col("window_start") + interval_micros(duration))
    )
    return result.select("window_start", "window_end", *keys, *[m.name for m in measures])


def _from_blocks(
    panes: DataFrame, duration: int, slide: int, keys: list[str], measures: list[Measure], types: dict
) -> DataFrame:
    """Windows over panes, from two rows per window at most."""
    parts = window_parts(panes, duration, slide, keys, measures, types)
    result = parts.groupBy("__start", *keys).agg(*[m.combined(types) for m in measures])
    if panes.schema["__pane"].dataType["start"].dataType.typeName() == "timestamp_ntz":
        elapsed = F.make_interval(secs=(F.col("__start") / F.lit(Decimal(1_000_000))).cast("decimal(18,6)"))
        begin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + elapsed
    else:
        begin = F.timestamp_micros("__start")
    result = result.withColumn("window_start", begin)
    result = result.withColumn("window_end", F.col("window_start") + interval_micros(duration))
    return result.select("window_start", "window_end", *keys, *[m.name for m in measures])


def window_parts(
    panes: DataFrame, duration: int, slide: int, keys: list[str], measures: list[Measure], types: dict
) -> DataFrame:
    """Partial results by ``__start`` of windows and keys: two rows per window at most, whatever number of panes it has.

    Time is cut into blocks as long as a window. A window is the end of one block, from the window's start on, and the
    beginning of the next, up to the window's end: running aggregates over a block from either side give both, for
    measures of any kind. A pane stands for all window bounds between it and the pane beside it. What one key brings to
    one task is one block. The running aggregates need no more exchange than the blocks themselves.
    """
    plain = panes.schema["__pane"].dataType["start"].dataType.typeName() == "timestamp_ntz"
    start = F.col("__pane.start")
    placed = panes.withColumn("__at", F.unix_micros(utc_instant(start) if plain else start))
    placed = placed.withColumn("__block", F.col("__at") - F.pmod("__at", F.lit(duration)))
    block = Window.partitionBy(*keys, "__block")
    from_start, from_end = (block.orderBy(order) for order in (F.asc("__at"), F.desc("__at")))
    parts = {name: how for m in measures for name, how in m.merges().items()}

    def running(order) -> list[Column]:
        over = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return [getattr(F, how)(name).over(over).cast(types[name]).alias(name) for name, how in parts.items()]

    def last_start(time: Column) -> Column:
        return time - F.pmod(time, F.lit(slide))

    # Windows that begin after the pane before, up to this one: this pane and all after it in the block are in them.
    before = F.coalesce(F.lead("__at").over(from_end), F.col("__block") - 1)
    ends = F.struct((last_start(before) + slide).alias("low"), last_start(F.col("__at")).alias("high"), *running(from_end))
    # Windows that end after this pane, up to the next one: this pane and all before it in the block are in them.
    after = F.coalesce(F.lead("__at").over(from_start), F.col("__block") + (duration - 1))
    low, high = last_start(F.col("__at") - duration) + slide, last_start(after - duration)
    beginnings = F.struct(low.alias("low"), high.alias("high"), *running(from_start))
    sides = placed.select(*keys, ends.alias("__ends"), beginnings.alias("__beginnings"))
    sides = sides.select(*keys, F.inline(F.array("__ends", "__beginnings"))).where("low <= high")
    return sides.withColumn("__start", F.explode(F.sequence("low", "high", F.lit(slide).cast("long"))))


def _sliding_stream(
    df: DataFrame, window: EventWindow, time_column: str, keys: list[str], measures: list[Measure]
) -> DataFrame:
    """Panes in one stateful aggregate, windows over finished panes in another."""
    duration, slide = to_micros(window.duration), window.slide_micros
    types = measure_types(df, measures)
    panes = df.groupBy(F.window(time_column, as_text(math.gcd(slide, duration))).alias("__pane"), *keys).agg(
        *[part for m in measures for part in m.partials(df)]
    )
    grouped = panes.groupBy(F.window("__pane", as_text(duration), as_text(slide)).alias("__window"), *keys)
    return _flat(grouped.agg(*[m.combined(types) for m in measures]), keys, measures)


def _sessions(
    df: DataFrame, window: EventWindow, time_column: str, keys: list[str], measures: list[Measure]
) -> DataFrame:
    """Aggregate to slots as wide as the gap first, then chain slots into sessions.

    Two events of one slot are less than a gap apart, so a slot never spans two sessions. What is left per key
    for the ordered step is at most one row per slot: its size depends on the time range of the data, not on
    how many rows a hot key has. Events exactly one gap apart share a session, as in Spark's session_window.
    """
    gap = to_micros(window.gap)
    types = measure_types(df, measures)
    slots = df.groupBy(F.window(time_column, as_text(gap)).alias("__slot"), *keys).agg(
        F.min(time_column).alias("__first"),
        F.max(time_column).alias("__last"),
        *[part for m in measures for part in m.partials(df)],
    )
    if not keys:
        return _chained(slots, gap, types, measures)
    in_order = Window.partitionBy(*keys).orderBy("__first")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    previous = F.lag("__last").over(in_order)
    opens = F.when(F.col("__first") <= previous + interval_micros(gap), 0).otherwise(1)
    sessions = (
        slots.withColumn("__opens", opens)
        .withColumn("__session", F.sum("__opens").over(so_far))
        .groupBy(*keys, "__session")
        .agg(
            F.min("__first").alias("window_start"),
            (F.max("__last") + interval_micros(gap)).alias("window_end"),
            *[m.combined(types) for m in measures],
        )
    )
    return sessions.select("window_start", "window_end", *keys, *[m.name for m in measures])


def _chained(slots: DataFrame, gap: int, types: dict, measures: list[Measure]) -> DataFrame:
    """Sessions over all slots at once, without bringing them into one task.

    Slots are chained within time ranges in parallel. What a range needs of those before it, the last event and
    the sessions opened so far, comes from one row per range.
    """
    # The range number must not change between uses, so it is stored and its lineage cut.
    ranges = stored(slots.repartitionByRange("__first").withColumn("__range", F.spark_partition_id()))
    by_range, in_range = Window.orderBy("__range"), Window.partitionBy("__range").orderBy("__first")
    lasts = ranges.groupBy("__range").agg(F.max("__last").alias("__top"))
    lasts = lasts.select("__range", F.lag("__top").over(by_range).alias("__before"))
    previous = F.coalesce(F.lag("__last").over(in_range), "__before")
    opens = F.when(F.col("__first") <= previous + interval_micros(gap), 0).otherwise(1)
    # Used twice, for the counts per range and for the sessions: working it out again costs less than to store it.
    chained = (
        ranges.join(F.broadcast(lasts), "__range")
        .withColumn("__opens", opens)
        .withColumn("__here", F.sum("__opens").over(in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )
    opened = chained.groupBy("__range").agg(F.sum("__opens").alias("__in"))
    earlier = F.sum("__in").over(by_range.rowsBetween(Window.unboundedPreceding, -1))
    opened = opened.select("__range", F.coalesce(earlier, F.lit(0)).alias("__earlier"))
    sessions = (
        chained.join(F.broadcast(opened), "__range")
        .groupBy((F.col("__earlier") + F.col("__here")).alias("__session"))
        .agg(
            F.min("__first").alias("window_start"),
            (F.max("__last") + interval_micros(gap)).alias("window_end"),
            *[m.combined(types) for m in measures],
        )
    )
    return sessions.select("window_start", "window_end", *[m.name for m in measures])


def _flat(df: DataFrame, keys: list[str], measures: list[Measure]) -> DataFrame:
    return df.select(
        F.col("__window.start").alias("window_start"),
        F.col("__window.end").alias("window_end"),
        *keys,
        *[m.name for m in measures],
    )


def utc_instant(wall: Column) -> Column:
    """The instant of a TIMESTAMP_NTZ read as UTC wall time; a cast would take the session's zone and its clock changes."""
    seconds = F.unix_date(wall.cast("date")).cast("long") * 86_400 + F.hour(wall) * 3600 + F.minute(wall) * 60
    return F.timestamp_micros(seconds * F.lit(1_000_000) + (F.extract(F.lit("SECOND"), wall) * 1_000_000).cast("long"))


def utc_date(df: DataFrame, time_column: str) -> Column:
    """The date of an event time in UTC, for columns with and without zone."""
    if column_type(df, time_column).typeName() == "timestamp_ntz":
        return F.col(time_column).cast("date")
    days = F.floor(F.unix_micros(F.col(time_column)) / F.lit(86_400_000_000))
    return F.date_from_unix_date(days.cast("int"))


def with_event_date(df: DataFrame, time_column: str = "window_start") -> DataFrame:
    """Add ``event_date`` (UTC), the column file sinks partition by."""
    return df.withColumn("event_date", utc_date(df, time_column))
