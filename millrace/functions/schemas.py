"""Schemas of the event log, of order events and of change events."""

from __future__ import annotations

from pyspark.sql import types as T


def _row(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_STR, _INT, _LONG, _DOUBLE, _TIME = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.TimestampType(),
)

# The columns of Spark's Kafka source; a file log carries the same ones.
LOG_SCHEMA = _row(
    ("key", T.BinaryType()),
    ("value", T.BinaryType()),
    ("topic", _STR),
    ("partition", _INT),
    ("offset", _LONG),
    ("timestamp", _TIME),
    ("timestampType", _INT),
)

# The fields of an order event, and below those of a change event's source.
ORDER_EVENT = _row(
    ("order_id", _STR),
    ("customer_id", _STR),
    ("product_id", _STR),
    ("quantity", _INT),
    ("unit_price", _DOUBLE),
    ("event_time", _TIME),
    ("event_type", _STR),
)
# from_json makes every field nullable, so the fields an event must carry are checked by name.
ORDER_REQUIRED = ("order_id", "customer_id", "event_time")

ORDER_EVENT_WITH_METADATA = T.StructType(
    [
        *ORDER_EVENT.fields,
        T.StructField("status", _STR),
        T.StructField("payment_method", _STR),
        T.StructField(
            "_metadata",
            _row(("producer", _STR), ("is_late", T.BooleanType()), ("produced_at", _TIME)),
        ),
    ]
)

CHANGE_SOURCE = _row(
    ("version", _STR),
    ("connector", _STR),
    ("name", _STR),
    ("ts_ms", _LONG),
    ("db", _STR),
    ("schema", _STR),
    ("table", _STR),
)

# The row image a change carries unless the caller gives another one.
CUSTOMER_ROW = _row(("id", _STR), ("name", _STR), ("email", _STR), ("updated_at", _STR))


def change_envelope(row: T.StructType) -> T.StructType:
    """The change-event envelope around row images of schema ``row``."""
    return _row(
        ("schema", _row(("type", _STR), ("name", _STR))),
        (
            "payload",
            _row(
                ("before", row),
                ("after", row),
                ("source", CHANGE_SOURCE),
                ("op", _STR),
                ("ts_ms", _LONG),
            ),
        ),
    )
