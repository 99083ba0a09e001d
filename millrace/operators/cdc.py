"""Change events: decoding, current state, changed fields, counts and delays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.schemas import CHANGE_SOURCE, CUSTOMER_ROW, change_envelope
from millrace.operators.decode import MALFORMED, MISSING, parsed_once
from millrace.operators.windows import EventWindow, aggregate_windows

# Fixed values of the change-event format.
OPERATIONS = {"c": "create", "u": "update", "d": "delete", "r": "read"}
UNKNOWN_OPERATION = "unknown_operation"


def decode_changes(log: DataFrame, row: T.StructType = CUSTOMER_ROW) -> DataFrame:
    """Decode change envelopes with row images of schema ``row``.

    Columns: ``op, ts_ms, change_time``, one ``source_*`` per source field, ``before, after``, and
    ``partition, offset`` of the message. A delete is often followed by a message without a value, which
    only tells a compacted topic to forget the key; such messages hold no change and are left out. What cannot be
    read is null here; ``decode_changes_checked`` tells it apart.
    """
    envelope = F.from_json(F.col("value").cast("string"), change_envelope(row))
    return (
        log.select(parsed_once(envelope["payload"], F.col("value").isNotNull()), "partition", "offset")
        .select(*_change_columns(), "partition", "offset")
    )


def _change_columns(payload: str = "") -> list[Column]:
    return [
        F.col(f"{payload}op").alias("op"),
        F.col(f"{payload}ts_ms").alias("ts_ms"),
        F.timestamp_millis(f"{payload}ts_ms").alias("change_time"),
        *[F.col(f"{payload}source.{name}").alias(f"source_{name}") for name in CHANGE_SOURCE.names],
        F.col(f"{payload}before").alias("before"),
        F.col(f"{payload}after").alias("after"),
    ]


def decode_changes_checked(log: DataFrame, row: T.StructType = CUSTOMER_ROW, key: str = "id") -> DataFrame:
    """``decode_changes`` with a check of every message.

    Adds ``topic``, ``quarantine_reason`` (null for a good change) and ``raw_value`` (the text of a bad message). Bad are messages
    that are no whole envelope or hold a value of a wrong type (``malformed_json``), those without ``op``, ``ts_ms``, source table, or the row
    image with a key that the operation needs (``missing_required``), and unknown operations (``unknown_operation``).
    ``split_changes`` picks the two sides.
    """
    envelope = T.StructType([*change_envelope(row).fields, T.StructField("__corrupt", T.StringType())])
    parsed = F.from_json(F.col("value").cast("string"), envelope, {"columnNameOfCorruptRecord": "__corrupt"})
    decoded = (
        log.select(parsed_once(parsed, F.col("value").isNotNull()), F.col("value").cast("string").alias("raw_value"), "topic", "partition", "offset")
        .select(*_change_columns("payload."), "topic", "partition", "offset", "__corrupt", "raw_value")
    )
    reason = F.when(F.col("__corrupt").isNotNull(), MALFORMED).otherwise(_fault(key))
    checked = decoded.withColumn("quarantine_reason", reason)
    bad_text = F.when(F.col("quarantine_reason").isNotNull(), F.col("raw_value"))
    return checked.withColumn("raw_value", bad_text).drop("__corrupt")


def _fault(key: str) -> Column:
    """Why a decoded change cannot be applied; null if it can."""
    deletes = F.col("op") == "d"
    row_key = F.when(deletes, F.col(f"before.{key}")).otherwise(F.col(f"after.{key}"))
    told = F.col("op").isNotNull() & F.col("ts_ms").isNotNull() & F.col("source_table").isNotNull()
    return (
        F.when(~told, MISSING)
        .when(~F.col("op").isin(*OPERATIONS), UNKNOWN_OPERATION)
        .when(row_key.isNull(), MISSING)
    )


def with_operation(changes: DataFrame) -> DataFrame:
    """Add ``operation``, the name of ``op``; null if ``op`` is unknown or missing."""
    return changes.withColumn("operation", operation_name(F.col("op")))


def operation_name(op: Column) -> Column:
    name = F.lit(None).cast("string")
    for code, word in OPERATIONS.items():
        name = F.when(op == code, word).otherwise(name)
    return name


def split_changes(changes: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Changes that can be applied, and the others for quarantine.

    Those of ``decode_changes_checked`` carry the verdict. Others are judged by what decoding has left of them:
    operation, time, table, and the key in the row image that the operation needs.
    """
    fault = F.col("quarantine_reason") if "quarantine_reason" in changes.columns else _fault(key)
    return changes.where(fault.isNull()), changes.where(fault.isNotNull())


def row_image(changes: DataFrame, key: str = "id") -> DataFrame:
    """Add ``row_key`` and ``image``: the state after a change, or before it for a delete."""
    image = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    row_key = F.coalesce(F.col(f"after.{key}"), F.col(f"before.{key}"))
    return changes.withColumn("row_key", row_key).withColumn("image", image)


def newest_changes(changes: DataFrame, key: str = "id", *, table_column: str = "source_table") -> DataFrame:
    """The newest change per table and key, deletes included.

    Newest by ``ts_ms``, then by ``offset``; a key must keep to one partition for the offset to decide a tie.
    Map-side combination leaves one row per key and task, however many changes one key has.
    """
    known, _ = split_changes(changes, key)
    newest = F.max_by(F.struct("op", "after", "ts_ms", "offset"), F.struct("ts_ms", "offset"))
    return (
        row_image(known, key)
        .groupBy(table_column, "row_key")
        .agg(newest.alias("__newest"))
        .select(table_column, "row_key", "__newest.*")
    )


def live_rows(newest: DataFrame) -> DataFrame:
    """The rows that exist after the newest changes: their ``after`` fields as columns."""
    return newest.where(F.col("op") != "d").select("source_table", "after.*")


def latest_state(changes: DataFrame, key: str = "id") -> DataFrame:
    """The tables as they are after all changes: ``source_table`` and the row fields."""
    return live_rows(newest_changes(changes, key))


def changed_fields(changes: DataFrame, key: str = "id") -> DataFrame:
    """One row per field an update changed: ``row_key, ts_ms, field, old_value, new_value`` (values as text)."""
    updates = row_image(changes.where(F.col("op") == "u"), key)
    fields = changes.schema["after"].dataType.names
    entry = [
        F.struct(
            F.lit(name).alias("field"),
            F.col(f"before.`{name}`").cast("string").alias("old_value"),
            F.col(f"after.`{name}`").cast("string").alias("new_value"),
        )
        for name in fields
    ]
    differing = F.filter(F.array(*entry), lambda e: ~e["old_value"].eqNullSafe(e["new_value"]))
    return updates.select("source_table", "row_key", "ts_ms", F.explode(differing).alias("__e")).select(
        "source_table", "row_key", "ts_ms", "__e.*"
    )


def operation_counts(changes: DataFrame, *group_by: str) -> DataFrame:
    return with_operation(changes).groupBy(*group_by, "operation").agg(F.count(F.lit(1)).alias("change_count"))


def route_changes(changes: DataFrame, tables: Sequence[str]) -> dict[str, DataFrame]:
    """The changes of each source table, for consumers that read the changes on their own."""
    return {table: changes.where(F.col("source_table") == table) for table in tables}


def write_routed(changes: DataFrame, path: str) -> None:
    """Write the changes of all source tables in one pass, one directory per table."""
    changes.write.mode("append").partitionBy("source_table").parquet(path)


def change_counts_per_window(changes: DataFrame, window: EventWindow) -> DataFrame:
    """Changes per window of change time, source table and operation."""
    return aggregate_windows(
        with_operation(changes),
        window,
        time_column="change_time",
        group_by=["source_table", "operation"],
        aggregations={"change_count": "count(*)"},
    )


def with_capture_delay(changes: DataFrame) -> DataFrame:
    """Add ``capture_delay_ms``, the time from the change in the database to its event."""
    return changes.withColumn("capture_delay_ms", F.col("ts_ms") - F.col("source_ts_ms"))


def capture_delay(changes: DataFrame, *group_by: str) -> DataFrame:
    delay = F.col("capture_delay_ms")
    return with_capture_delay(changes).groupBy(*(group_by or ("source_table",))).agg(
        F.count(delay).alias("change_count"),
        F.min(delay).alias("min_delay_ms"),
        F.max(delay).alias("max_delay_ms"),
        F.avg(delay).alias("avg_delay_ms"),
    )
