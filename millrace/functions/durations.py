"""Durations written as Spark interval text, e.g. ``"5 minutes"``."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_MICROS = {
    "microsecond": 1,
    "millisecond": 1_000,
    "second": 1_000_000,
    "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
    "week": 604_800_000_000,
}
_PART = re.compile(r"(\d+)\s+([a-z]+?)s?(?:\s+|$)")


def to_micros(text: str) -> int:
    """Length of ``text`` in microseconds; months and years have no fixed length and are refused."""
    body = text.strip().lower()
    body = body.removeprefix("interval ").strip()
    total, at = 0, 0
    while at < len(body):
        part = _PART.match(body, at)
        if part is None or part.group(2) not in _UNIT_MICROS:
            raise ValueError(f"not a fixed-length duration: {text!r}")
        total += int(part.group(1)) * _UNIT_MICROS[part.group(2)]
        at = part.end()
    if total <= 0:
        raise ValueError(f"a duration must be positive: {text!r}")
    return total


def interval(text: str) -> Column:
    """``text`` as an interval literal."""
    return interval_micros(to_micros(text))


def interval_micros(micros: int) -> Column:
    """Elapsed time: unlike days of a day-time interval, it does not follow clock changes of the session's zone."""
    return F.make_interval(secs=F.lit(Decimal(micros) / 1_000_000).cast("decimal(18,6)"))


def as_text(micros: int) -> str:
    return f"{micros} microseconds"
