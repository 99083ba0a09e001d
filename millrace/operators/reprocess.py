"""Look-back reprocessing: recompute the windows that late events belong to."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.durations import as_text, interval_micros, to_micros
from millrace.functions.folders import stored
from millrace.functions.measures import DEFAULT_SPEC, column_type, parse_measures
from millrace.operators.broadcasts import anti_join, semi_join
from millrace.operators.windows import DATE_COLUMN, EventWindow, aggregate_windows, utc_instant

_TOUCHED = "__touched"
_WIDEN = 4
_DAY = 86_400_000_000
# More ranges of days than this are joined to fewer, wider ones: a filter has to stay readable for the planner.
_MOST_RANGES = 200


def reprocess(
    on_time: DataFrame,
    late: DataFrame,
    window: EventWindow,
    *,
    time_column: str = "event_time",
    group_by: Sequence[str] = (),
    aggregations: Mapping[str, str] | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """The windows touched by a late event, aggregated over on-time and late events together.

    Both logs need the event time, the keys and the measured columns; what else they have does not matter.
    The result has the shape of ``aggregate_windows``, for ``UpsertTable.apply_corrections``. Of the on-time log only
    the days that touched windows lie in are read, by partitions where it has ``utc_date``, and of these only rows in
    the panes of touched windows and keys go into the aggregate. Late rows carry a mark through it, and windows without one
    are left out. Sessions change their bounds; see ``reprocess_sessions``.
    """
    if window.kind not in ("tumbling", "sliding"):
        raise ValueError(f"not for windows of kind {window.kind!r}")
    panes = stored(_touched_panes(late, window, time_column, group_by))
    days = [row["day"] for row in panes.select(F.floor(_micros(panes, "__pane_start") / _DAY).alias("day")).distinct().collect()]
    near = _in_days(on_time, time_column, [(day, day + 1) for day in days]).select(*_used(time_column, group_by, aggregations))
    width = as_text(math.gcd(window.slide_micros, to_micros(window.duration)))
    placed = near.withColumn("__pane", F.window(time_column, width)["start"])
    keys = {"__pane": "__pane_start", **{key: f"__touched_{key}" for key in group_by}}
    near = semi_join(placed, panes, keys, rows=panes.count(), limit=broadcast_rows).drop("__pane")
    return _touched(near, late, window, time_column, group_by, aggregations)


def _touched_panes(late: DataFrame, window: EventWindow, time_column: str, group_by: Sequence[str]) -> DataFrame:
    """The panes, as wide as the divisor of slide and duration, of all windows that hold a late event, with its keys."""
    duration, slide = to_micros(window.duration), window.slide_micros
    pane = math.gcd(slide, duration)
    keys = [F.col(key).alias(f"__touched_{key}") for key in group_by]
    own = late.select(F.window(time_column, as_text(pane))["start"].alias("__at"), *keys).distinct()
    newest = own.withColumn("__newest", F.col("__at") if pane == slide else F.window("__at", as_text(slide))["start"])
    starts = F.sequence(F.col("__newest"), F.col("__at") - interval_micros(duration - 1), -interval_micros(slide))
    last = F.col("__newest") + interval_micros(duration - pane)
    panes = F.sequence(F.array_min(starts), last, interval_micros(pane))
    return newest.select(F.explode(panes).alias("__pane_start"), *[f"__touched_{key}" for key in group_by]).distinct()


def _micros(df: DataFrame, column: str) -> Column:
    """Microseconds since the epoch; times without zone count as UTC."""
    plain = column_type(df, column).typeName() == "timestamp_ntz"
    return F.unix_micros(utc_instant(F.col(column)) if plain else F.col(column))


def _in_days(log: DataFrame, time_column: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """The rows within ranges of days since the epoch, ends exclusive, by filters that reach the scan."""
    joined = _joined(ranges)
    inside = F.lit(False)
    plain = column_type(log, time_column).typeName() == "timestamp_ntz"
    for first, end in joined:
        low, high = (_literal(day * _DAY, plain) for day in (first, end))
        inside = inside | ((F.col(time_column) >= low) & (F.col(time_column) < high))
    if DATE_COLUMN in log.columns:
        dates = F.lit(False)
        for first, end in joined:
            low, high = (F.lit(str(date(1970, 1, 1) + timedelta(days=day))).cast("date") for day in (first, end - 1))
            dates = dates | F.col(DATE_COLUMN).between(low, high)
        inside = inside & dates
    return log.where(inside)


def _literal(micros: int, plain: bool) -> Column:
    if plain:
        return F.lit(str(datetime(1970, 1, 1) + timedelta(microseconds=micros))).cast("timestamp_ntz")
    return F.timestamp_micros(F.lit(micros))


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges that neither meet nor are too many: the narrowest gaps are closed."""
    joined: list[tuple[int, int]] = []
    for first, end in sorted(ranges):
        if joined and first <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
        else:
            joined.append((first, end))
    while len(joined) > _MOST_RANGES:
        gaps = sorted(range(1, len(joined)), key=lambda k: joined[k][0] - joined[k - 1][1])[: len(joined) - _MOST_RANGES]
        for k in sorted(gaps, reverse=True):
            joined[k - 1 : k + 1] = [(joined[k - 1][0], joined[k][1])]
    return joined


def reprocess_sessions(
    on_time: DataFrame,
    late: DataFrame,
    window: EventWindow,
    *,
    time_column: str = "event_time",
    group_by: Sequence[str],
    aggregations: Mapping[str, str] | None = None,
    lookback: str = "1 day",
    broadcast_rows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The sessions touched by a late event, and the former sessions they take the place of.

    A late event can lengthen a session or join two. The second result holds the bounds and keys of former
    sessions to delete before the first is upserted. Only keys with late events are looked at. How far a session reaches
    is not known beforehand: the log is read ``lookback`` around the days of late events, and further for the keys with
    a touched session that meets the edge.
    """
    if window.kind != "session":
        raise ValueError(f"not for windows of kind {window.kind!r}")
    keys = list(group_by)
    gap, reach = to_micros(window.gap), max(1, math.ceil(to_micros(lookback) / _DAY))
    touched = late.where(F.col(time_column).isNotNull())
    found = touched.select(F.floor(_micros(touched, time_column) / _DAY).alias("day")).distinct().collect()
    days = [row["day"] for row in found]
    wanted = {key: f"__touched_{key}" for key in keys}
    pending = stored(touched.select(*[F.col(key).alias(name) for key, name in wanted.items()]).distinct())
    new, former = [], []
    while True:
        ranges = _joined([(day - reach, day + 1 + reach) for day in days])
        count = pending.count()
        nearby = _in_days(on_time, time_column, ranges).select(*_used(time_column, keys, aggregations))
        near = semi_join(nearby, pending, wanted, rows=count, limit=broadcast_rows)
        mine = semi_join(touched, pending, wanted, rows=count, limit=broadcast_rows)
        sessions = stored(_touched(near, mine, window, time_column, keys, aggregations))
        # A session this near to an edge might go on in the part of the log not read.
        start, end = _micros(sessions, "window_start"), _micros(sessions, "window_end")
        cut = F.lit(False)
        for first, last in ranges:
            cut = cut | (start.between(first * _DAY, first * _DAY + gap)) | ((end >= last * _DAY) & (start < last * _DAY))
        further = stored(sessions.where(cut).select(*[F.col(key).alias(name) for key, name in wanted.items()]).distinct())
        rest = further.count()
        old = aggregate_windows(near, window, time_column=time_column, group_by=keys)
        new.append(anti_join(sessions, further, wanted, rows=rest, limit=broadcast_rows))
        former.append(anti_join(old, further, wanted, rows=rest, limit=broadcast_rows))
        if not rest:
            break
        pending, reach = further, reach * _WIDEN
    corrected = reduce(DataFrame.unionByName, new)
    return corrected, stale_sessions(reduce(DataFrame.unionByName, former), corrected, group_by=keys)


def touched_windows(
    marked: DataFrame,
    window: EventWindow,
    *,
    late_column: str = "is_late",
    time_column: str = "event_time",
    group_by: Sequence[str] = (),
    aggregations: Mapping[str, str] | None = None,
) -> DataFrame:
    """The windows of a table that hold a row marked late, aggregated over all their rows."""
    spec = {**(DEFAULT_SPEC if aggregations is None else aggregations), _TOUCHED: f"max({late_column})"}
    result = aggregate_windows(marked, window, time_column=time_column, group_by=group_by, aggregations=spec)
    return result.where(_TOUCHED).drop(_TOUCHED)


def _used(time_column: str, group_by: Sequence[str], aggregations: Mapping[str, str] | None) -> list[str]:
    """The columns that the windows are made of."""
    measured = [m.column for m in parse_measures(aggregations) if m.column != "*"]
    return list(dict.fromkeys([time_column, *group_by, *measured]))


def _touched(
    near: DataFrame,
    late: DataFrame,
    window: EventWindow,
    time_column: str,
    group_by: Sequence[str],
    aggregations: Mapping[str, str] | None,
) -> DataFrame:
    used = _used(time_column, group_by, aggregations)
    marked = near.select(*used, F.lit(False).alias("__late")).unionByName(late.select(*used, F.lit(True).alias("__late")))
    return touched_windows(
        marked,
        window,
        late_column="__late",
        time_column=time_column,
        group_by=group_by,
        aggregations=aggregations,
    )


def stale_sessions(
    old: DataFrame, new: DataFrame, *, group_by: Sequence[str], start: str = "window_start", end: str = "window_end"
) -> DataFrame:
    """The sessions of ``old`` that a session of ``new`` takes the place of, and that are not in it unchanged.

    A late event can lengthen a session or join two; their former bounds must then be deleted. Every former
    session lies inside one new one, so a running "last new session" per key finds it without pairing rows.
    """
    keys = list(group_by)
    both = old.select(*keys, start, end, F.lit(1).alias("__old")).unionByName(
        new.select(*keys, start, end, F.lit(0).alias("__old"))
    )
    in_order = Window.partitionBy(*keys).orderBy(start, "__old").rowsBetween(Window.unboundedPreceding, 0)
    latest = F.last(F.when(F.col("__old") == 0, F.struct(start, end)), ignorenulls=True).over(in_order)
    inside = F.col(end) <= F.col(f"__new.{end}")
    same = (F.col(start) == F.col(f"__new.{start}")) & (F.col(end) == F.col(f"__new.{end}"))
    return both.withColumn("__new", latest).where((F.col("__old") == 1) & inside & ~same).select(start, end, *keys)
