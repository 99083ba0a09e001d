from millrace.functions.durations import interval, to_micros
from millrace.functions.measures import DEFAULT_SPEC, ORDER_METRICS, Measure, parse_measures
from millrace.functions.schemas import (
    CHANGE_SOURCE,
    CUSTOMER_ROW,
    LOG_SCHEMA,
    ORDER_EVENT,
    ORDER_EVENT_WITH_METADATA,
    ORDER_REQUIRED,
    change_envelope,
)
from millrace.functions.types import NAMED_TYPES, resolve_type, schema_from_config

__all__ = [
    "CHANGE_SOURCE",
    "CUSTOMER_ROW",
    "DEFAULT_SPEC",
    "LOG_SCHEMA",
    "Measure",
    "NAMED_TYPES",
    "ORDER_EVENT",
    "ORDER_EVENT_WITH_METADATA",
    "ORDER_METRICS",
    "ORDER_REQUIRED",
    "change_envelope",
    "interval",
    "parse_measures",
    "resolve_type",
    "schema_from_config",
    "to_micros",
]
