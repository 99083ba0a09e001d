"""The history of a table from its changes: whether it is whole, and what a row was at a time.

Changes are put in order by ranges of key, time and offset, not by key, so that a key with a third of all changes is
dealt over many tasks. What a range needs of those before it comes from one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.folders import remove_stored, stored
from millrace.operators.cdc import row_image

KEYS = ("source_table", "row_key")
ORDER = ("ts_ms", "offset")
#: Rows that one task puts in order.
ROWS_OF_A_RANGE = 100_000
NO_BEGINNING, CHANGED_BETWEEN = "no_beginning", "changed_between"


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``df`` with the last ``value`` that is not null among earlier rows of the same keys, by ``order``, as ``name``.

    Rows are ordered by ranges in parallel; a key may span any number of them. Null keys are equal to each other. Of
    rows that ``order`` does not tell apart, any may come first. ``df`` is computed once, and all its columns are stored:
    leave out what is not needed.
    """
    return _with_neighbour(df, keys, order, value, name, later=False)


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``with_previous`` the other way round: the first ``value`` that is not null among later rows."""
    return _with_neighbour(df, keys, order, value, name, later=True)


def _with_neighbour(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, *, later: bool) -> DataFrame:
    ranges = _ranges(df, *keys, *order)
    carried = F.struct(*[F.col(key).alias(f"k{k}") for k, key in enumerate(keys)], value.alias("value"))
    marked = ranges.withColumn("__own", F.when(value.isNotNull(), carried))
    place = [F.col(column) for column in (*keys, *order)]
    # Descending order puts nulls last, so it is the whole ascending order turned round.
    towards = [column.desc() if later else column.asc() for column in (*place, F.col("__range"))]
    here = Window.partitionBy("__range").orderBy(*towards[:-1]).rowsBetween(Window.unboundedPreceding, -1)
    nearest = (F.min_by if later else F.max_by)("__own", F.struct(*place))
    ends = marked.where(F.col("__own").isNotNull()).groupBy("__range").agg(nearest.alias("__end"))
    every = ranges.select("__range").distinct().join(ends, "__range", "left")
    before = Window.orderBy(towards[-1]).rowsBetween(Window.unboundedPreceding, -1)
    carry = every.select("__range", F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    found = marked.join(F.broadcast(carry), "__range").withColumn("__found", F.coalesce(F.last("__own", ignorenulls=True).over(here), "__carry"))
    same = F.lit(True)
    for k, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"__found.k{k}"))
    return found.select(*df.columns, F.when(F.col("__found").isNotNull() & same, F.col("__found.value")).alias(name))


def _ranges(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``__range``, its number among ranges of ``columns``; stored, as the number must not change between uses.

    Finding the bounds of ranges reads all rows once more than dealing them out, so ``df`` is stored before that.
    """
    once = stored(df)
    tasks = -(-once.count() // ROWS_OF_A_RANGE)
    dealt = once.repartitionByRange(tasks, *columns) if tasks > 1 else once.repartitionByRange(*columns)
    ranges = stored(dealt.withColumn("__range", F.spark_partition_id()))
    remove_stored(once)
    return ranges


def chain_breaks(changes: DataFrame, key: str = "id") -> DataFrame:
    """The changes whose ``before`` is not what the change before them left: some change between them is missing.

    Result: ``source_table, row_key, ts_ms, offset, op, reason``, which is ``changed_between``, or ``no_beginning``
    for an update or delete of a row that no earlier change made. Snapshot reads (``r``) tell the row as it is, whatever
    came before. ``changes`` are decoded and known (``split_changes``).
    """
    # What the row is after a change: a struct that is there for deletes too.
    state = F.struct(F.col("after").alias("row"))
    told = row_image(changes, key).select(*KEYS, *ORDER, "op", "before", "after")
    placed = with_previous(told, KEYS, ORDER, state, "__former")
    begins = F.col("__former").isNull()
    expected = F.col("__former.row")
    reason = F.when(F.col("op") == "r", None)
    reason = reason.when(begins & F.col("before").isNotNull(), NO_BEGINNING)
    reason = reason.when(~begins & ~F.to_json("before").eqNullSafe(F.to_json(expected)), CHANGED_BETWEEN)
    return placed.withColumn("reason", reason).where("reason is not null").select(*KEYS, *ORDER, "op", "reason")


def history(changes: DataFrame, key: str = "id") -> DataFrame:
    """What each row was and when: ``source_table, row_key, valid_from, valid_to, image`` (times as in ``ts_ms``).

    An interval begins with a change and ends before the next one of its row; the last is open (null). Deletes end an
    interval and begin none. Of changes at the same time the one with the greater offset counts.
    """
    told = row_image(changes, key).select(*KEYS, *ORDER, "after")
    placed = with_next(told, KEYS, ORDER, F.struct(F.col("ts_ms").alias("since")), "__next")
    held = placed.where("after is not null and (__next is null or __next.since > ts_ms)")
    return held.select(*KEYS, F.col("ts_ms").alias("valid_from"), F.col("__next.since").alias("valid_to"), F.col("after").alias("image"))


def as_of(changes: DataFrame, lookups: DataFrame, key: str = "id", *, time_column: str = "at_ms") -> DataFrame:
    """``lookups`` (``source_table, row_key``, a time in milliseconds and any other columns) with ``image``: what the row was
    then, null where it was not there. A change counts from its own millisecond on.

    Lookups go among the changes by range, as changes do: no key's lookups meet all its changes.
    """
    state = F.struct(F.col("after").alias("row"))
    known = row_image(changes, key).select(
        *KEYS, F.col("ts_ms").alias("__at"), F.lit(0).alias("__asks"), F.col("offset").alias("__place"), state.alias("__state"), F.lit(None).cast(lookups.schema).alias("__lookup")
    )
    asked = lookups.select(
        *KEYS, F.col(time_column).cast("long").alias("__at"), F.lit(1).alias("__asks"), F.lit(0).cast("long").alias("__place"),
        F.lit(None).cast(known.schema["__state"].dataType).alias("__state"), F.struct(*lookups.columns).alias("__lookup"),
    )
    placed = with_previous(known.unionByName(asked), KEYS, ("__at", "__asks", "__place"), F.col("__state"), "__found")
    return placed.where("__asks = 1").select("__lookup.*", F.col("__found.row").alias("image"))
