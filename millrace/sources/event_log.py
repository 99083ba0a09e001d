"""The event log as files, with the columns of a Kafka topic."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.schemas import LOG_SCHEMA

FORMATS = ("parquet", "json")


def _known(format: str) -> str:
    if format not in FORMATS:
        raise ValueError(f"unknown log format {format!r}; one of {', '.join(FORMATS)}")
    return format


def write_log(log: DataFrame, path: str, *, format: str = "parquet") -> None:
    """Append messages to a file log, one directory per topic and partition."""
    messages = log.select(*LOG_SCHEMA.names)
    messages.write.mode("append").partitionBy("topic", "partition").format(_known(format)).save(path)


def read_log(spark: SparkSession, path: str, *, format: str = "parquet") -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).format(_known(format)).load(path).select(*LOG_SCHEMA.names)


def stream_log(
    spark: SparkSession, path: str, *, format: str = "parquet", max_files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(LOG_SCHEMA).format(_known(format))
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path).select(*LOG_SCHEMA.names)


def replay(
    log: DataFrame,
    *,
    topics: Sequence[str] | None = None,
    offsets: Mapping[int, tuple[int, int]] | None = None,
    since: datetime | Column | None = None,
    until: datetime | Column | None = None,
) -> DataFrame:
    """A bounded part of the log.

    ``offsets`` maps partitions to ``(first, end)`` with ``end`` left out, and leaves other partitions out;
    ``since`` counts, ``until`` does not. Topic and partition prune directories, the rest reaches the file scan.
    """
    part = log
    if topics is not None:
        part = part.where(F.col("topic").isin(*topics))
    if offsets is not None:
        wanted = F.lit(False)
        for partition, (first, end) in offsets.items():
            in_range = (F.col("offset") >= first) & (F.col("offset") < end)
            wanted = wanted | ((F.col("partition") == partition) & in_range)
        part = part.where(F.col("partition").isin(*offsets)).where(wanted)
    if since is not None:
        part = part.where(F.col("timestamp") >= since)
    if until is not None:
        part = part.where(F.col("timestamp") < until)
    return part
