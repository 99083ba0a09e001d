"""From log messages to typed events and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.durations import interval
from millrace.functions.schemas import ORDER_EVENT, ORDER_REQUIRED

LINEAGE = ("key", "topic", "partition", "offset")
MALFORMED = "malformed_json"
MISSING = "missing_required"
FUTURE = "future_time"
PAST = "past_time"

# The default JSON formats cut timestamps to milliseconds.
_JSON_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "ignoreNullFields": "false",
}


def _text(name: str) -> Column:
    return F.col(name).cast("string")


def _lineage(log: DataFrame) -> list[Column]:
    return [_text("key").alias("key") if name == "key" else F.col(name) for name in LINEAGE if name in log.columns]


def parsed_once(structs: Column, where: Column | None = None) -> Column:
    """The fields of a struct column as columns, computed once per row; rows for which ``where`` does not hold are left out.

    A filter on fields selected from a parsed struct would be moved below the parsing and repeat it, once per
    field it names. Filters are not moved below a generator. A filter on the text would in the same way be moved
    below what makes the text and make it twice, so it is part of the generator.
    """
    parsed = F.array(structs)
    return F.inline(parsed if where is None else F.when(where, parsed))


def decode_events(log: DataFrame, schema: T.StructType = ORDER_EVENT, *, lineage: bool = False) -> DataFrame:
    """Decode message values to the fields of ``schema`` plus ``kafka_timestamp``.

    A value that cannot be read gives null fields; ``decode_checked`` tells such rows apart. ``lineage`` keeps
    key, topic, partition and offset.
    """
    _refuse_names(schema, LINEAGE if lineage else ())
    return log.select(
        parsed_once(F.from_json(_text("value"), schema)),
        *(_lineage(log) if lineage else []),
        F.col("timestamp").alias("kafka_timestamp"),
    )


def wrong_time(time: Column, arrival: Column, max_ahead: str | None, max_behind: str | None = None) -> Column:
    """Why an event time cannot be right: it is further ahead of the arrival, or behind it, than a clock may be wrong.

    Null where it can be right, and where there is no arrival to compare it with. One event far ahead would move
    the watermark past all others; event times far behind would each open a day of their own in the logs.
    """
    reason = F.lit(None).cast("string")
    if max_behind is not None:
        reason = F.when(time < arrival - interval(max_behind), PAST).otherwise(reason)
    if max_ahead is not None:
        reason = F.when(time > arrival + interval(max_ahead), FUTURE).otherwise(reason)
    return reason


def decode_checked(
    log: DataFrame,
    schema: T.StructType = ORDER_EVENT,
    required: Sequence[str] = ORDER_REQUIRED,
    *,
    time_column: str | None = None,
    max_ahead: str | None = None,
    max_behind: str | None = None,
) -> DataFrame:
    """Decode every message, good or bad.

    Adds the lineage columns, ``quarantine_reason`` (null for a good event) and ``raw_value`` (the text of a
    bad one). ``good_events`` and ``quarantined`` pick the two sides. With ``time_column``, events whose time is
    further from the message's than ``max_ahead`` and ``max_behind`` allow are bad as well.
    """
    unknown = set(required) - set(schema.names)
    if unknown:
        raise ValueError(f"required fields not in the schema: {sorted(unknown)}")
    _refuse_names(schema, (*LINEAGE, "quarantine_reason", "raw_value"))
    checked = T.StructType([*schema.fields, T.StructField("__corrupt", T.StringType())])
    event = F.from_json(_text("value"), checked, {"columnNameOfCorruptRecord": "__corrupt"})
    # A null value gives a null row without a corrupt text, so it counts as missing its required fields.
    reason = F.when(F.col("__corrupt").isNotNull(), MALFORMED)
    for name in required:
        reason = reason.when(F.col(f"`{name}`").isNull(), MISSING)
    if time_column is not None:
        wrong = wrong_time(F.col(f"`{time_column}`"), F.col("kafka_timestamp"), max_ahead, max_behind)
        reason = F.coalesce(reason, wrong)
    return (
        log.select(
            parsed_once(event),
            F.col("value").alias("__value"),
            *_lineage(log),
            F.col("timestamp").alias("kafka_timestamp"),
        )
        .withColumn("quarantine_reason", reason)
        .withColumn("raw_value", F.when(F.col("quarantine_reason").isNotNull(), _text("__value")))
        .drop("__corrupt", "__value")
    )


def _refuse_names(schema: T.StructType, taken: Sequence[str]) -> None:
    clash = set(schema.names) & {*taken, "kafka_timestamp"}
    if clash:
        raise ValueError(f"event fields have names of the log: {sorted(clash)}")


def good_events(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("quarantine_reason").isNull()).drop("quarantine_reason", "raw_value")


def no_bad_events(checked: DataFrame) -> DataFrame:
    """The good events; the first bad one is an error that names its place in the log."""
    place = F.concat_ws("/", *[F.col(name).cast("string") for name in ("topic", "partition", "offset")])
    error = F.raise_error(F.concat(F.lit("bad event at "), place, F.lit(": "), F.col("quarantine_reason")))
    kept = [name for name in checked.columns if name not in ("quarantine_reason", "raw_value")]
    event = F.when(F.col("quarantine_reason").isNotNull(), error).otherwise(F.struct(*kept))
    # As a generator, so that no later filter is moved below the check and hides the bad event from it.
    return checked.select(parsed_once(event))


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("quarantine_reason").isNotNull()).select(
        *LINEAGE, "kafka_timestamp", "raw_value", "quarantine_reason"
    )


def flatten_metadata(events: DataFrame) -> DataFrame:
    """Lift the producer metadata of extended order events to columns."""
    return events.select(
        *[name for name in events.columns if name != "_metadata"],
        F.col("_metadata.producer").alias("producer"),
        F.col("_metadata.is_late").alias("is_late"),
        F.col("_metadata.produced_at").alias("produced_at"),
    )


def message(df: DataFrame, key: str | Sequence[str] | None, columns: Sequence[str] | None = None) -> list[Column]:
    """``key`` (unless there is none) and JSON ``value`` of a message for each row."""
    names = [key] if isinstance(key, str) else list(key or ())
    value = F.to_json(F.struct(*(columns or df.columns)), _JSON_FORMATS).alias("value")
    if not names:
        return [value]
    text = _text(names[0]) if len(names) == 1 else F.to_json(F.struct(*names), _JSON_FORMATS)
    return [text.alias("key"), value]


def encode_events(
    df: DataFrame, key: str | Sequence[str] | None = "order_id", columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows as message ``key`` and JSON ``value``, the columns a Kafka sink takes.

    Several key columns become one JSON object as key; without one, messages have no key.
    """
    return df.select(*message(df, key, columns))


def to_log(
    df: DataFrame,
    *,
    key: str,
    columns: Sequence[str],
    topic: str,
    partition: Column,
    offset: Column,
    timestamp: Column,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Rows as messages with all columns of the event log, for a log kept as files, and the columns to ``keep``."""
    placed = [
        F.lit(topic).alias("topic"),
        partition.cast("int").alias("partition"),
        offset.cast("long").alias("offset"),
        timestamp.cast("timestamp").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    ]
    parts = df.select(*message(df, key, columns), *placed, *keep)
    return parts.withColumns({name: F.col(name).cast("binary") for name in ("key", "value")})
