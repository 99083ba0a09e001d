"""Joins to a lookup table that is broadcast only when it was counted and found small."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000
#: Bits of the filter of a large lookup per row of it, and the most there are, as a power of two: 64 bits make a row.
FILTER_BITS, MOST_FILTER_BITS = 16, 24


def join_lookup(df: DataFrame, lookup: DataFrame, on: Sequence[str], *, rows: int, limit: int | None = None) -> DataFrame:
    """Left join to ``lookup``, which the caller has materialised and counted as ``rows`` narrow rows.

    Above the limit no hint is given: the join is a shuffle join, and adaptive execution splits its hot keys.
    """
    small = rows <= (BROADCAST_ROWS if limit is None else limit)
    return df.join(F.broadcast(lookup) if small else lookup, list(on), "left")


def semi_join(df: DataFrame, lookup: DataFrame, on: Mapping[str, str], *, rows: int, limit: int | None = None) -> DataFrame:
    """The rows of ``df`` with a match in ``lookup``; ``on`` maps columns, and null matches null.

    A lookup above the limit is joined by shuffle. Rows that cannot match are left out before it, by a Bloom filter of
    the lookup's keys, which is broadcast and whose size is bounded; the more keys, the more of the others it lets pass.
    """
    if rows > (BROADCAST_ROWS if limit is None else limit):
        df = may_match(df, lookup, on, rows)
    return _match(df, lookup, on, rows, limit, "left_semi")


def anti_join(df: DataFrame, lookup: DataFrame, on: Mapping[str, str], *, rows: int, limit: int | None = None) -> DataFrame:
    """The rows of ``df`` without a match in ``lookup``."""
    return _match(df, lookup, on, rows, limit, "left_anti")


def _match(df: DataFrame, lookup: DataFrame, on: Mapping[str, str], rows: int, limit: int | None, how: str) -> DataFrame:
    small = rows <= (BROADCAST_ROWS if limit is None else limit)
    same = [F.col(column).eqNullSafe(F.col(other)) for column, other in on.items()]
    return df.join(F.broadcast(lookup) if small else lookup, same, how)


def may_match(df: DataFrame, lookup: DataFrame, on: Mapping[str, str], rows: int) -> DataFrame:
    """The rows of ``df`` whose key is in a Bloom filter of ``lookup``: all with a match, and some without one.

    All columns of ``df`` are read, so it should have no more than are needed.
    """
    bits = 1 << min(MOST_FILTER_BITS, max(10, (FILTER_BITS * rows).bit_length()))
    held = lookup.select(F.pmod(F.xxhash64(*on.values()), F.lit(bits)).alias("__at"))
    words = held.groupBy((F.col("__at") - F.pmod("__at", F.lit(64))).alias("__word"))
    bitmap = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(__at % 64 as int))")).alias("__bits"))
    placed = df.withColumn("__at", F.pmod(F.xxhash64(*on), F.lit(bits)))
    found = placed.join(F.broadcast(bitmap), F.col("__at") - F.pmod("__at", F.lit(64)) == F.col("__word"))
    passed = found.where("(shiftright(__bits, cast(__at % 64 as int)) & 1) = 1")
    # A semi-join that follows would be moved below this join, and the filter be of no use. It isn't moved below a generator.
    return passed.select(F.inline(F.array(F.struct(*[F.col(f"`{name}`") for name in df.columns]))))
