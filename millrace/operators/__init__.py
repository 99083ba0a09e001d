from millrace.operators.cdc import (
    OPERATIONS,
    capture_delay,
    change_counts_per_window,
    changed_fields,
    decode_changes,
    decode_changes_checked,
    latest_state,
    live_rows,
    newest_changes,
    operation_counts,
    route_changes,
    row_image,
    split_changes,
    with_capture_delay,
    with_operation,
    write_routed,
)
from millrace.operators.decode import (
    decode_checked,
    decode_events,
    encode_events,
    flatten_metadata,
    good_events,
    quarantined,
    to_log,
)
from millrace.operators.dedup import deduplicate
from millrace.operators.history import as_of, chain_breaks, history
from millrace.operators.late import (
    batch_watermarks,
    classify_lateness,
    enrich_late,
    lateness_profile,
    mark_late,
    split_late,
    with_late_metadata,
    with_lateness,
)
from millrace.operators.quantiles import pane_sketches, rank_error, window_quantiles
from millrace.operators.reprocess import reprocess, reprocess_sessions, stale_sessions, touched_windows
from millrace.operators.windows import EventWindow, aggregate_windows, with_event_date, with_event_watermark

__all__ = [
    "EventWindow",
    "OPERATIONS",
    "aggregate_windows",
    "as_of",
    "batch_watermarks",
    "capture_delay",
    "chain_breaks",
    "change_counts_per_window",
    "changed_fields",
    "classify_lateness",
    "decode_changes",
    "decode_changes_checked",
    "decode_checked",
    "decode_events",
    "deduplicate",
    "encode_events",
    "enrich_late",
    "flatten_metadata",
    "good_events",
    "history",
    "lateness_profile",
    "latest_state",
    "live_rows",
    "mark_late",
    "newest_changes",
    "operation_counts",
    "pane_sketches",
    "quarantined",
    "rank_error",
    "reprocess",
    "reprocess_sessions",
    "route_changes",
    "row_image",
    "split_changes",
    "split_late",
    "stale_sessions",
    "to_log",
    "touched_windows",
    "window_quantiles",
    "with_capture_delay",
    "with_event_date",
    "with_event_watermark",
    "with_late_metadata",
    "with_lateness",
    "with_operation",
    "write_routed",
]
