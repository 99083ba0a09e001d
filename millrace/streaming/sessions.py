"""Sessions of a stream that take late events: each change of a session is told, and what it takes the place of."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from math import isnan
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.durations import to_micros
from millrace.functions.measures import Measure, column_type, measure_types, parse_measures
from millrace.streaming.files import publish_batch
from millrace.streaming.upsert import UpsertTable

#: What a row of the result says: the session is so from now on, is no more, or an event came too late to be placed.
IS, WAS, TOO_LATE = "session", "retracted", "too_late"
CHANGE = "change"


def session_changes(
    events: DataFrame,
    gap: str,
    *,
    time_column: str = "event_time",
    group_by: Sequence[str],
    aggregations: Mapping[str, str] | None = None,
    horizon: str = "7 days",
) -> DataFrame:
    """The changes of sessions per micro-batch: ``window_start, window_end``, the keys, the measures and ``change``.

    Spark's own session window drops an event once its session is closed. Here the sessions of a key stay in the
    state until they end ``horizon`` before the key's latest event: an event that comes late lengthens the session it
    belongs to or joins two, and the former bounds are told as ``retracted``. Events older than that are told as
    ``too_late``, with their time as both bounds, and lost to no one. Applied in order (``apply_session_changes``),
    the changes give at any time what ``aggregate_windows`` gives for a table of all events that have come, open
    sessions included. No watermark is needed and none is used.

    State per key is one value, an array of its sessions within the horizon: it is read and written at once, however many
    sessions there are. Rows without event time are in no session. Needs the RocksDB
    state store, which the pipeline's settings name.
    """
    if not group_by:
        raise ValueError("sessions of a stream need at least one group_by column")
    measures, keys = parse_measures(aggregations), list(group_by)
    types = measure_types(events, measures)
    parts = [T.StructField(name, types[name]) for m in measures for name in m.merges()]
    fields = [T.StructField(key, column_type(events, key)) for key in keys]
    bounds = [T.StructField(name, T.LongType()) for name in ("first", "last")]
    output = T.StructType([*fields, *bounds, *parts, T.StructField(CHANGE, T.StringType())])
    used = [m.column for m in measures if m.column != "*"]
    # Names that begin with an underscore don't reach the processor.
    timed = events.where(F.col(time_column).isNotNull()).select(
        *[F.col(key) for key in keys],
        F.unix_micros(F.col(time_column).cast("timestamp")).alias("event_micros"),
        *[F.col(column).alias(f"value_{k}") for k, column in enumerate(used)],
    )
    processor = _Sessions(keys, measures, T.StructType([*bounds, *parts]), to_micros(gap), to_micros(horizon))
    changed = timed.groupBy(*keys).transformWithState(processor, output, "Update", "None")
    width = F.when(F.col(CHANGE) == TOO_LATE, 0).otherwise(to_micros(gap))
    return changed.select(
        F.timestamp_micros("first").alias("window_start"),
        F.timestamp_micros(F.col("last") + width).alias("window_end"),
        *keys,
        *[_measure(m, types).alias(m.name) for m in measures],
        CHANGE,
    )


def _measure(measure: Measure, types: Mapping[str, T.DataType]):
    first, *second = [F.col(name) for name in measure.merges()]
    return ((first / F.nullif(second[0], F.lit(0))) if second else first).cast(types[measure.name])


def apply_session_changes(table: UpsertTable) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the sessions in ``table``, and events that came too late beside it."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            too_late = F.col(CHANGE) == TOO_LATE
            publish_batch(batch.where(too_late).drop(CHANGE), f"{table.path}/too_late", batch_id, root=table.path)
            table.upsert_batch(batch.where(~too_late).withColumn(CHANGE, F.col(CHANGE) == WAS), batch_id, deleted=CHANGE)
        finally:
            batch.unpersist()

    return apply


class _Sessions(StatefulProcessor):
    """The sessions of one key, as tuples of first and last event time and partial results."""

    def __init__(self, keys: list[str], measures: list[Measure], schema: T.StructType, gap: int, horizon: int) -> None:
        self.keys, self.measures, self.schema, self.gap, self.horizon = keys, measures, schema, gap, horizon
        self.merges = [how for m in measures for how in m.merges().values()]
        self.result = Row(*keys, *schema.names, CHANGE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        held = T.StructType([T.StructField("sessions", T.ArrayType(self.schema, False))])
        self.held = handle.getValueState("sessions", held)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.held.get()
        before = [] if held is None else [tuple(row) for row in held[0]]
        oldest = max((row[1] for row in before), default=None)
        oldest = None if oldest is None else oldest - self.horizon
        new: list[tuple] = []
        late: list[tuple] = []
        for row in map(self._entry, rows):
            (late if oldest is not None and row[0] < oldest else new).append(row)
        after = self._chained(sorted([*before, *new], key=lambda row: row[:2]))
        newest = max((row[1] for row in after), default=0)
        self.held.update(([row for row in after if row[1] >= newest - self.horizon],))
        bounds = {row[:2] for row in after}
        for row in set(after) - set(before):
            yield self.result(*key, *row, IS)
        for row in before:
            if row[:2] not in bounds:
                yield self.result(*key, *row, WAS)
        for row in late:
            yield self.result(*key, *row, TOO_LATE)

    def _entry(self, row: Row) -> tuple:
        """An event in the shape of a session of that event alone."""
        values: list = []
        place = 0
        for m in self.measures:
            if m.column == "*":
                values.append(1)
                continue
            own = row[f"value_{place}"]
            place += 1
            kind = self.schema[next(iter(m.merges()))].dataType
            if own is not None and isinstance(kind, T.DoubleType):
                own = None if isnan(own) else float(own)
            there = int(own is not None)
            values += [there] if m.function == "count" else [own, there] if m.function == "avg" else [own]
        return (row["event_micros"], row["event_micros"], *values)

    def _chained(self, rows: list[tuple]) -> list[tuple]:
        """Sessions from rows by first event: those at most a gap apart become one."""
        found: list[list] = []
        for row in rows:
            if found and row[0] <= found[-1][1] + self.gap:
                last = found[-1]
                last[1] = max(last[1], row[1])
                for place, how in enumerate(self.merges, 2):
                    last[place] = _merged(how, last[place], row[place])
            else:
                found.append(list(row))
        return [tuple(row) for row in found]


def _merged(how: str, a: Any, b: Any) -> Any:
    if a is None or b is None:
        return b if a is None else a
    return a + b if how == "sum" else min(a, b) if how == "min" else max(a, b)
