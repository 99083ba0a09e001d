"""The configured pipeline: source, decoding, watermark, windows, sink, as one chain of DataFrame functions."""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from millrace.operators.decode import decode_checked, good_events, no_bad_events, quarantined
from millrace.operators.dedup import deduplicate
from millrace.operators.reprocess import reprocess, reprocess_sessions
from millrace.operators.windows import aggregate_windows, with_event_watermark
from millrace.plans.config import PipelineConfig
from millrace.sources.event_log import read_log, replay, stream_log
from millrace.sources.kafka import kafka_replay, kafka_stream
from millrace.streaming.router import LateRouter, ReaderPace
from millrace.streaming.sinks import console_sink, kafka_sink, output_mode, parquet_sink, table_sink
from millrace.streaming.state import open_windows
from millrace.streaming.triggers import AVAILABLE_NOW, triggered
from millrace.streaming.upsert import SEEN, UpsertTable, merge_corrections, merge_into


# Sessions of a hot key are merged in the task that read them, before the shuffle.
_POLL_SECONDS = 0.5
_MERGE_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def session_settings(config: PipelineConfig) -> dict[str, str]:
    """Session settings that suit the pipeline; the number of state partitions is fixed by the first checkpoint."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # State larger than memory, and only changed state uploaded per batch.
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        _MERGE_SESSIONS: "true",
        # The router writes three sides at a time instead of sorting by side.
        "spark.sql.maxConcurrentOutputFileWriters": "4",
    }
    if config.shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(config.shuffle_partitions)
    return settings


def build_session(config: PipelineConfig) -> SparkSession:
    builder = SparkSession.builder.appName(config.app_name)
    for name, value in session_settings(config).items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


@contextmanager
def query_settings(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """Set while queries start: each query keeps a copy of the settings it was started with."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class EventPipeline:
    """One configuration for a stream (``start``, ``stop``) and for a table (``on_table``).

    With ``late.path`` the stream is split by the late router first, and the windows are computed from its
    on-time log; otherwise Spark's watermark drops late rows. The session belongs to the caller.
    """

    def __init__(self, config: Mapping[str, Any] | PipelineConfig) -> None:
        self.config = config if isinstance(config, PipelineConfig) else PipelineConfig.from_dict(config)
        self.queries: list[StreamingQuery] = []
        self._pace: ReaderPace | None = None

    def log_stream(self, spark: SparkSession) -> DataFrame:
        source = self.config.source
        if source.kind == "kafka":
            kafka = dict(source.kafka)
            return kafka_stream(spark, kafka.pop("bootstrap_servers"), kafka.pop("topics"), **kafka)
        if source.kind == "files":
            return stream_log(
                spark, source.path, format=source.format, max_files_per_trigger=source.max_files_per_trigger
            )
        raise ValueError("events are handed to on_table or start, not read")

    def log_table(self, spark: SparkSession, **bounds: Any) -> DataFrame:
        """The log as a table, to run the pipeline over its history or a part of it.

        Bounds of topics are ``start`` and ``end`` (``by_timestamp``), of file logs those of ``replay``: ``topics,
        offsets, since, until``.
        """
        source = self.config.source
        if source.kind == "kafka":
            names = ("bootstrap_servers", "topics", "min_partitions")
            kafka = {name: source.kafka[name] for name in names if name in source.kafka}
            return kafka_replay(spark, kafka.pop("bootstrap_servers"), kafka.pop("topics"), **kafka, **bounds)
        if source.kind != "files":
            raise ValueError("only file logs and topics are read as tables")
        return replay(read_log(spark, source.path, format=source.format), **bounds)

    def decode(self, log: DataFrame) -> DataFrame:
        """Good events of a log; events of an ``events`` source come decoded and checked already.

        A bad event goes to quarantine, is dropped, or ends the query, as configured.
        """
        if self.config.source.kind == "events":
            return log
        checked = self._checked(log)
        return good_events(checked) if self.config.bad_events != "fail" else no_bad_events(checked)

    def _checked(self, log: DataFrame) -> DataFrame:
        config = self.config
        bounds = {"time_column": config.time_column, "max_ahead": config.max_ahead, "max_behind": config.max_behind}
        return decode_checked(log, config.schema, config.required, **bounds)

    def transform(self, events: DataFrame) -> DataFrame:
        config = self.config
        stream = with_event_watermark(events, config.time_column, config.delay)
        if config.dedup:
            stream = deduplicate(stream, config.dedup, salts=config.dedup_salts)
        return aggregate_windows(
            stream,
            config.window,
            time_column=config.time_column,
            group_by=config.group_by,
            aggregations=self._measures(events),
            stream_panes=config.panes,
        )

    def open_windows(self, spark: SparkSession, log: DataFrame) -> DataFrame:
        """The windows that the stream has begun and not yet written, from its state; ``log`` tells the types alone."""
        config = self.config
        if config.window.kind == "none" or config.panes:
            raise ValueError("only windows of a single aggregate can be read from the state")
        events = self.decode(log)
        if config.late_path is not None:
            events = events.withColumn("batch_id", F.lit(None).cast("long"))
        parts = {"group_by": config.group_by, "aggregations": self._measures(events)}
        found = open_windows(spark, self._checkpoint(), events, config.window, **parts)
        return found.drop(SEEN) if SEEN in found.columns else found

    def _measures(self, events: DataFrame) -> Mapping[str, str]:
        """Results for a table behind the router also say which of its batches they have seen."""
        tells = self._corrected() and self.config.window.kind != "none" and "batch_id" in events.columns
        return {**self.config.aggregations, SEEN: "max(batch_id)"} if tells else self.config.aggregations

    def _corrected(self) -> bool:
        return self.config.late_path is not None and self.config.output.kind == "table"

    def correct(self, spark: SparkSession, schema: T.StructType | None = None) -> None:
        """Write the windows that late events belong to again, from both logs of the router, into the output table.

        May run beside the stream and as often as wanted: what the stream writes later has seen more of the log, and
        the next correction more than that. ``schema`` is that of the events where they come decoded.
        """
        config = self.config
        if not self._corrected() or config.window.kind == "none":
            raise ValueError("corrections are for windows behind the late router, in a table")
        schema, router = schema or config.schema, self.router()
        on_time, late = router.read_on_time(spark, schema), router.read_late(spark, schema)
        parts = {"time_column": config.time_column, "group_by": config.group_by, "aggregations": self._measures(on_time)}
        if config.window.kind == "session":
            rows, former = reprocess_sessions(on_time, late, config.window, **parts)
        else:
            rows, former = reprocess(on_time, late, config.window, **parts), None
        if config.output.table is None:
            self.upserted().apply_corrections(rows, former)
        else:
            merge_corrections(config.output.table, self._result_key(), SEEN, rows, former)

    def on_table(self, log: DataFrame) -> DataFrame:
        """The pipeline over a bounded log: every window, no watermark."""
        return self.transform(self.decode(log))

    def start(self, spark: SparkSession, log: DataFrame | None = None) -> list[StreamingQuery]:
        """Start all queries of the pipeline and return them, the one that writes the result last."""
        if any(query.isActive for query in self.queries):
            raise RuntimeError("the pipeline is running")
        self._checkpoint()
        self.queries = []
        try:
            with query_settings(spark, self._query_settings()):
                return self._start(spark, log)
        except Exception:
            self.stop()
            raise

    def _start(self, spark: SparkSession, log: DataFrame | None) -> list[StreamingQuery]:
        log = self.log_stream(spark) if log is None else log
        if self.config.late_path is not None:
            events = self._route(spark, log)
        else:
            if self.config.quarantine_path is not None:
                self._keep(self._quarantine_writer(spark, log))
            events = self.decode(log)
        if self.config.late_path is not None and self.config.trigger == AVAILABLE_NOW:
            router = self.router()
            router.release(spark)
            while router.waiting(spark):
                self._writer_of(events).start().awaitTermination()
                router.note_read(spark)
                router.release(spark)
        if self.config.late_max_batches is not None:
            self._pace = self.router().follow(spark)
        self.queries.append(self._writer_of(events).start())
        if self._pace is not None:
            self._pace.of(self.queries[-1])
        return self.queries

    def _writer_of(self, events: DataFrame) -> DataStreamWriter:
        return triggered(self.writer(self.transform(events), self._checkpoint()), self.config.trigger)

    def stop(self) -> None:
        """Stop the queries after their running batch is given up; a restart resumes from the checkpoints."""
        for query in reversed(self.queries):
            query.stop()
        if self._pace is not None:
            self._pace.spark.streams.removeListener(self._pace)
            self._pace = None

    def await_all(self, timeout: float | None = None) -> bool:
        """Wait until all queries have ended; say whether they have. If one fails, the others are stopped and it raises."""
        until = None if timeout is None else time.monotonic() + timeout
        while active := [query for query in self.queries if query.isActive]:
            if any(query.exception() for query in self.queries if not query.isActive):
                break
            if until is not None and time.monotonic() >= until:
                return False
            active[0].awaitTermination(_POLL_SECONDS)
        failed = [error for query in self.queries if (error := query.exception())]
        if failed:
            self.stop()
            raise failed[0]
        return True

    def writer(self, result: DataFrame, checkpoint: str) -> DataStreamWriter:
        config, output = self.config, self.config.output
        mode = output_mode(config.window.kind, output.kind, deduplicated=bool(config.dedup))
        if output.kind == "console":
            return console_sink(result, mode, checkpoint)
        if output.kind == "parquet":
            time = config.time_column if config.window.kind == "none" else "window_start"
            return parquet_sink(
                result, output.path, checkpoint, partition_by=output.partition_by, time_column=time
            )
        if output.kind == "kafka":
            return kafka_sink(result, output.servers, output.topic, mode, checkpoint, key=self._result_key())
        if output.table is not None:
            seen = SEEN if SEEN in result.columns else None
            return table_sink(result, merge_into(output.table, self._result_key(), seen=seen), mode, checkpoint)
        return table_sink(result, self.upserted().upsert_batch, mode, checkpoint)

    def upserted(self) -> UpsertTable:
        """The table a ``table`` sink with a path writes to."""
        seen = SEEN if self._corrected() and self.config.window.kind != "none" else None
        return UpsertTable(self.config.output.path, self._result_key(), seen=seen)

    def router(self) -> LateRouter:
        return LateRouter(
            self.config.late_path,
            delay=self.config.delay,
            max_lateness=self.config.max_lateness,
            time_column=self.config.time_column,
            sized_files=self.config.late_sized_files,
            release=self.config.late_max_batches,
            max_ahead=self.config.max_ahead,
            max_behind=self.config.max_behind,
        )

    def _query_settings(self) -> dict[str, str]:
        """What ``session_settings`` recommends, for the queries alone: on the caller's own session it is not set."""
        settings = session_settings(self.config)
        if self.config.window.kind != "session":
            del settings[_MERGE_SESSIONS]
        if self.config.window.kind == "none" and not self.config.dedup:
            settings = {name: value for name, value in settings.items() if "stateStore" not in name}
        return settings

    def _result_key(self) -> list[str]:
        if self.config.output.key or self.config.window.kind == "none":
            return list(self.config.output.key)
        return ["window_start", "window_end", *self.config.group_by]

    def _route(self, spark: SparkSession, log: DataFrame) -> DataFrame:
        if self.config.source.kind == "events":
            checked = log
        else:
            checked = self._checked(log)
        router = self.router()
        query = router.start(checked, self.config.trigger)
        self.queries.append(query)
        if self.config.trigger == AVAILABLE_NOW:
            query.awaitTermination()
        if self.config.late_topic is not None:
            self._keep(self.late_writer(spark, checked.schema))
        return router.on_time_stream(spark, checked.schema, with_batch=self._corrected())

    def late_writer(self, spark: SparkSession, schema: T.StructType) -> DataStreamWriter:
        """The side output, sent on to a topic of late events."""
        topic, late = self.config.late_topic, self.router().late_stream(spark, schema)
        checkpoint = f"{self._checkpoint()}-late-topic"
        return kafka_sink(late, topic.servers, topic.topic, "append", checkpoint, key=topic.key)

    def _quarantine_writer(self, spark: SparkSession, log: DataFrame) -> DataStreamWriter:
        bad = quarantined(self._checked(log))
        checkpoint = f"{self._checkpoint()}-quarantine"
        return parquet_sink(bad, self.config.quarantine_path, checkpoint, partition_by=None)

    def _keep(self, writer: DataStreamWriter) -> None:
        self.queries.append(triggered(writer, self.config.trigger).start())

    def _checkpoint(self) -> str:
        if not self.config.checkpoint:
            raise ValueError("a stream needs a checkpoint folder of its own: set checkpoint")
        return self.config.checkpoint
