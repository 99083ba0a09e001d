"""Pipeline configuration: a nested dict, checked once and kept in frozen dataclasses."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from millrace.functions.durations import to_micros
from millrace.functions.measures import ORDER_METRICS, parse_measures
from millrace.functions.schemas import ORDER_EVENT, ORDER_REQUIRED
from millrace.functions.types import schema_from_config
from millrace.operators.windows import EventWindow
from millrace.streaming.sinks import SINKS

SOURCES = ("kafka", "files", "events")
# What happens to events that cannot be read or lack a required field; the late router has a quarantine of its own.
BAD_EVENTS = ("fail", "drop", "quarantine")

# What a section may hold; anything else is an error rather than a setting without effect.
_KEYS = {
    "": {
        "app_name", "kafka", "source", "schema", "required", "dedup", "dedup_salts", "watermark", "processing", "late",
        "quarantine", "output", "checkpoint", "trigger", "shuffle_partitions",
    },
    "kafka": {
        "bootstrap_servers", "topics", "starting_offsets", "fail_on_data_loss", "max_offsets_per_trigger",
        "min_partitions",
    },
    "source": {"type", "path", "format", "max_files_per_trigger"},
    "watermark": {"column", "delay", "max_ahead", "max_behind"},
    "processing": {"window_type", "window_duration", "slide_duration", "session_gap", "group_by", "aggregations", "panes"},
    "late": {"path", "max_lateness", "sized_files", "max_batches", "bootstrap_servers", "topic", "key"},
    "quarantine": {"path", "bad_events"},
    "output": {"type", "path", "partition_by", "bootstrap_servers", "topic", "key", "table"},
}


@dataclass(frozen=True)
class SourceConfig:
    kind: str
    kafka: Mapping[str, Any] = field(default_factory=dict)
    path: str | None = None
    format: str = "parquet"
    max_files_per_trigger: int | None = None


@dataclass(frozen=True)
class OutputConfig:
    kind: str = "console"
    path: str | None = None
    partition_by: str | None = "event_date"
    servers: str | None = None
    topic: str | None = None
    key: tuple[str, ...] = ()
    table: str | None = None


@dataclass(frozen=True)
class PipelineConfig:
    source: SourceConfig
    schema: T.StructType = field(default_factory=lambda: ORDER_EVENT)
    required: tuple[str, ...] = ORDER_REQUIRED
    dedup: tuple[str, ...] = ()
    dedup_salts: int = 8
    time_column: str = "event_time"
    delay: str = "10 minutes"
    max_ahead: str | None = "1 day"
    max_behind: str | None = None
    window: EventWindow = EventWindow()
    group_by: tuple[str, ...] = ("event_type",)
    aggregations: Mapping[str, str] = field(default_factory=lambda: dict(ORDER_METRICS))
    panes: bool = False
    late_path: str | None = None
    max_lateness: str = "1 hour"
    late_sized_files: bool = False
    late_max_batches: int | None = None
    late_topic: OutputConfig | None = None
    quarantine_path: str | None = None
    bad_events: str = "fail"
    output: OutputConfig = OutputConfig()
    checkpoint: str | None = None
    trigger: Mapping[str, Any] | None = None
    app_name: str = "event-pipeline"
    shuffle_partitions: int | None = None

    @classmethod
    def from_dict(cls, config: Mapping[str, Any]) -> PipelineConfig:
        _check_keys("", config)
        section = {name: config.get(name) or {} for name in _KEYS if name}
        for name, content in section.items():
            _check_keys(name, content)
        schema = schema_from_config(config["schema"]) if config.get("schema") else ORDER_EVENT
        watermark, processing, late = section["watermark"], section["processing"], section["late"]
        time_column = watermark.get("column", "event_time")
        default_required = ORDER_REQUIRED if schema is ORDER_EVENT else (time_column,)
        result = cls(
            source=_source(section["source"], section["kafka"]),
            schema=schema,
            required=tuple(config.get("required", default_required)),
            dedup=tuple(config.get("dedup") or ()),
            dedup_salts=int(config.get("dedup_salts", 8)),
            time_column=time_column,
            delay=watermark.get("delay", "10 minutes"),
            max_ahead=watermark.get("max_ahead", "1 day"),
            max_behind=watermark.get("max_behind"),
            window=EventWindow(
                processing.get("window_type", "tumbling"),
                processing.get("window_duration", "5 minutes"),
                processing.get("slide_duration", "1 minute")
                if processing.get("window_type") == "sliding"
                else None,
                processing.get("session_gap", "5 minutes"),
            ),
            group_by=tuple(processing.get("group_by", ("event_type",))),
            aggregations=dict(processing.get("aggregations") or ORDER_METRICS),
            panes=bool(processing.get("panes", False)),
            late_path=late.get("path"),
            max_lateness=late.get("max_lateness", "1 hour"),
            late_sized_files=bool(late.get("sized_files", False)),
            late_max_batches=late.get("max_batches"),
            late_topic=_output({**_topic(late), "type": "kafka"}) if late.get("topic") else None,
            quarantine_path=section["quarantine"].get("path"),
            bad_events=section["quarantine"].get("bad_events", "quarantine" if section["quarantine"].get("path") else "fail"),
            output=_output(section["output"]),
            checkpoint=config.get("checkpoint"),
            trigger=config.get("trigger"),
            app_name=config.get("app_name", "event-pipeline"),
            shuffle_partitions=config.get("shuffle_partitions"),
        )
        result._check()
        return result

    def _check(self) -> None:
        for duration in filter(None, (self.delay, self.max_ahead, self.max_behind)):
            to_micros(duration)
        to_micros(self.max_lateness)
        names = set(self.schema.names)
        used = {self.time_column, *self.required, *self.dedup}
        if self.window.kind != "none":
            used |= set(self.group_by)
            used |= {m.column for m in parse_measures(self.aggregations) if m.column != "*"}
        if self.source.kind != "events" and used - names - {"kafka_timestamp"}:
            raise ValueError(f"not in the schema: {sorted(used - names)}")
        if self.window.kind == "session" and not self.group_by:
            raise ValueError("sessions of a stream need at least one group_by column")
        if self.panes and not (self.window.kind == "sliding" and self.late_path and self.output.kind == "parquet"):
            raise ValueError("panes are for sliding windows behind the late router, written to parquet")
        if self.late_topic and not self.late_path:
            raise ValueError("a topic of late events is filled from the late router's path; give both")
        if self.bad_events not in BAD_EVENTS or (self.bad_events == "quarantine") != bool(self.quarantine_path):
            raise ValueError("bad events fail, are dropped, or go to quarantine, which needs a path")
        if self.late_path and self.quarantine_path:
            raise ValueError("the late router has a quarantine of its own; give one path")


def _check_keys(section: str, content: Mapping[str, Any]) -> None:
    unknown = set(content) - _KEYS[section]
    if unknown:
        raise ValueError(f"unknown settings in {section or 'the configuration'}: {sorted(unknown)}")


def _source(source: Mapping[str, Any], kafka: Mapping[str, Any]) -> SourceConfig:
    kind = source.get("type", "kafka")
    if kind not in SOURCES:
        raise ValueError(f"unknown source {kind!r}; one of {', '.join(SOURCES)}")
    if kind == "kafka" and not (kafka.get("bootstrap_servers") and kafka.get("topics")):
        raise ValueError("a Kafka source needs bootstrap_servers and topics")
    if kind == "files" and not source.get("path"):
        raise ValueError("a file source needs a path")
    return SourceConfig(
        kind, dict(kafka), source.get("path"), source.get("format", "parquet"), source.get("max_files_per_trigger")
    )


def _topic(late: Mapping[str, Any]) -> dict[str, Any]:
    return {name: late[name] for name in ("bootstrap_servers", "topic", "key") if name in late}


def _output(output: Mapping[str, Any]) -> OutputConfig:
    kind = output.get("type", "console")
    if kind not in SINKS:
        raise ValueError(f"unknown sink {kind!r}; one of {', '.join(SINKS)}")
    needs = {"parquet": ("path",), "kafka": ("bootstrap_servers", "topic")}.get(kind, ())
    missing = [name for name in needs if not output.get(name)]
    if kind == "table" and not (output.get("path") or output.get("table")):
        missing = ["path or table"]
    if missing:
        raise ValueError(f"a {kind} sink needs {', '.join(missing)}")
    key = output.get("key") or ()
    return OutputConfig(
        kind,
        output.get("path"),
        output.get("partition_by", "event_date"),
        output.get("bootstrap_servers"),
        output.get("topic"),
        (key,) if isinstance(key, str) else tuple(key),
        output.get("table"),
    )
