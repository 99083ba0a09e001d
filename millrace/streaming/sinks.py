"""Where results go: console, parquet, Kafka, or a table that is upserted."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from millrace.operators.decode import encode_events
from millrace.operators.windows import with_event_date
from millrace.streaming.triggers import triggered

SINKS = ("console", "parquet", "kafka", "table")


def output_mode(window_kind: str, sink: str, *, deduplicated: bool = False) -> str:
    """The output mode that Spark supports and the sink can take.

    Fixed windows can be shown and upserted while they still change. Files cannot be changed, sessions of a
    stream have no update mode, and neither has an aggregate behind another stateful operator.
    """
    if sink not in SINKS:
        raise ValueError(f"unknown sink {sink!r}; one of {', '.join(SINKS)}")
    fixed = window_kind in ("tumbling", "sliding")
    return "update" if fixed and sink != "parquet" and not deduplicated else "append"


def console_sink(df: DataFrame, mode: str, checkpoint: str) -> DataStreamWriter:
    return _writer(df, mode, checkpoint).format("console").option("truncate", "false")


def parquet_sink(
    df: DataFrame, path: str, checkpoint: str, *, partition_by: str | None = "event_date", time_column: str | None = None
) -> DataStreamWriter:
    """Append to a parquet folder, by default one directory per event date.

    ``event_date`` is derived from the window start, or from ``time_column``, where the rows have none.
    """
    if partition_by == "event_date" and "event_date" not in df.columns:
        df = with_event_date(df, time_column or "window_start")
    if partition_by is not None and partition_by not in df.columns:
        raise ValueError(f"no column {partition_by!r} to partition by")
    writer = _writer(df, "append", checkpoint).format("parquet").option("path", path)
    return writer if partition_by is None else writer.partitionBy(partition_by)


def kafka_options(servers: str, topic: str) -> dict[str, str]:
    if not servers or not topic:
        raise ValueError("a Kafka sink needs bootstrap servers and a topic")
    return {"kafka.bootstrap.servers": servers, "topic": topic}


def kafka_sink(
    df: DataFrame, servers: str, topic: str, mode: str, checkpoint: str, *, key: str | Sequence[str] | None = None
) -> DataStreamWriter:
    """Rows as JSON messages. Delivery is at least once: a repeated batch is sent again."""
    options = kafka_options(servers, topic)
    return _writer(encode_events(df, key), mode, checkpoint).format("kafka").options(**options)


def table_sink(
    df: DataFrame, upsert: Callable[[DataFrame, int], None], mode: str, checkpoint: str
) -> DataStreamWriter:
    return _writer(df, mode, checkpoint).foreachBatch(upsert)


def _writer(df: DataFrame, mode: str, checkpoint: str) -> DataStreamWriter:
    if not checkpoint:
        raise ValueError("a stream needs a checkpoint folder of its own")
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)


def run(writer: DataStreamWriter, trigger: dict | None = None) -> StreamingQuery:
    return triggered(writer, trigger).start()
