"""Kafka topics as streams, and bounded parts of them as tables.

Needs Spark's Kafka connector on the class path. The option maps are separate functions, so they can be
checked and reused without it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

Position = str | Mapping[str, Mapping[int | str, int]]


def position_text(position: Position) -> str:
    """``earliest``, ``latest``, or ``{topic: {partition: offset}}`` as the connector takes them."""
    if isinstance(position, str):
        return position
    return json.dumps({t: {str(p): o for p, o in parts.items()} for t, parts in position.items()}, sort_keys=True)


def subscription(servers: str, topics: Sequence[str], fail_on_data_loss: bool | str = False) -> dict[str, str]:
    names = [topics] if isinstance(topics, str) else list(topics)
    if not servers or not names or not all(names):
        raise ValueError("bootstrap servers and at least one topic are needed")
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": ",".join(names),
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }


def stream_options(
    servers: str,
    topics: Sequence[str],
    *,
    starting_offsets: Position = "latest",
    fail_on_data_loss: bool | str = False,
    max_offsets_per_trigger: int | None = None,
    min_partitions: int | None = None,
) -> dict[str, str]:
    """An unbounded read; ``min_partitions`` splits large topic partitions over more tasks."""
    options = subscription(servers, topics, fail_on_data_loss)
    options["startingOffsets"] = position_text(starting_offsets)
    if max_offsets_per_trigger is not None:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    return options


def replay_options(
    servers: str,
    topics: Sequence[str],
    *,
    start: Position = "earliest",
    end: Position = "latest",
    by_timestamp: bool = False,
    fail_on_data_loss: bool | str = True,
    min_partitions: int | None = None,
) -> dict[str, str]:
    """A bounded read by offsets, or by epoch milliseconds per partition with ``by_timestamp``.

    Offsets that the topic no longer holds are an error, unless it is asked to leave them out.
    """
    options = subscription(servers, topics, fail_on_data_loss)
    for name, position in (("startingOffsets", start), ("endingOffsets", end)):
        timed = by_timestamp and not isinstance(position, str)
        options[name + ("ByTimestamp" if timed else "")] = position_text(position)
    if min_partitions is not None:
        options["minPartitions"] = str(min_partitions)
    return options


def kafka_stream(spark: SparkSession, servers: str, topics: Sequence[str], **settings) -> DataFrame:
    return spark.readStream.format("kafka").options(**stream_options(servers, topics, **settings)).load()


def kafka_replay(spark: SparkSession, servers: str, topics: Sequence[str], **settings) -> DataFrame:
    return spark.read.format("kafka").options(**replay_options(servers, topics, **settings)).load()
