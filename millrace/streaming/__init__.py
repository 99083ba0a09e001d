from millrace.streaming.duplicates import UniqueEvents
from millrace.streaming.router import LATE, ON_TIME, QUARANTINE, LateRouter, write_late_events
from millrace.streaming.sessions import apply_session_changes, session_changes
from millrace.streaming.sinks import console_sink, kafka_options, kafka_sink, output_mode, parquet_sink, run, table_sink
from millrace.streaming.state import open_windows
from millrace.streaming.triggers import AVAILABLE_NOW, triggered
from millrace.streaming.upsert import ChangeTable, UpsertTable, merge_into

__all__ = [
    "AVAILABLE_NOW",
    "ChangeTable",
    "LATE",
    "LateRouter",
    "ON_TIME",
    "QUARANTINE",
    "UniqueEvents",
    "UpsertTable",
    "apply_session_changes",
    "console_sink",
    "kafka_options",
    "kafka_sink",
    "merge_into",
    "open_windows",
    "output_mode",
    "parquet_sink",
    "run",
    "session_changes",
    "table_sink",
    "triggered",
    "write_late_events",
]
