"""Quantiles that can be put together: one sketch per pane and group, merged to any windows of these panes."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.durations import as_text, to_micros
from millrace.operators.windows import EventWindow

#: Items a sketch keeps at its largest level: below so many values it is exact.
ACCURACY = 800
PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def rank_error(accuracy: int = ACCURACY) -> float:
    """How far, as a share of all values, the rank of an answer may be from the one asked for, in 99 of 100 cases."""
    return 2.296 / accuracy**0.9021


def pane_sketches(
    df: DataFrame, column: str, pane: str, *, time_column: str = "event_time", group_by: Sequence[str] = (), accuracy: int = ACCURACY
) -> DataFrame:
    """``pane_start``, the keys, ``sketch`` and ``n`` (values in it) of a whole-numbered column, by pane of event time.

    Sketches are of bounded size, whatever a pane holds, and are made map side first. Nulls are in none; a pane without
    values has no row. They can be kept, and later panes added, without the rows they came from.
    """
    present = df.where(F.col(column).isNotNull())
    grouped = present.groupBy(F.window(time_column, as_text(to_micros(pane)))["start"].alias("pane_start"), *group_by)
    return grouped.agg(F.kll_sketch_agg_bigint(F.col(column).cast("long"), accuracy).alias("sketch"), F.count(F.lit(1)).alias("n"))


def window_quantiles(
    sketches: DataFrame,
    window: EventWindow,
    pane: str,
    *,
    group_by: Sequence[str] = (),
    percentiles: Mapping[str, float] = PERCENTILES,
    accuracy: int = ACCURACY,
) -> DataFrame:
    """``window_start, window_end``, the keys, ``n`` and the percentiles, from the sketches of panes.

    ``pane`` must divide the window and its slide. Answers are values that were there, with a rank as near to the one asked
    for as ``rank_error`` says.
    """
    if window.kind not in ("tumbling", "sliding"):
        raise ValueError(f"not for windows of kind {window.kind!r}")
    if math.gcd(window.slide_micros, to_micros(window.duration)) % to_micros(pane):
        raise ValueError(f"panes of {pane} do not make up the windows")
    grouped = sketches.groupBy(window.column(F.col("pane_start")).alias("__window"), *group_by)
    merged = grouped.agg(F.kll_merge_agg_bigint("sketch", accuracy).alias("__sketch"), F.sum("n").alias("n"))
    return merged.select(
        F.col("__window.start").alias("window_start"),
        F.col("__window.end").alias("window_end"),
        *group_by,
        "n",
        *[F.kll_sketch_get_quantile_bigint("__sketch", F.lit(rank)).alias(name) for name, rank in percentiles.items()],
    )
