"""Hand-made streams: a folder that gets one micro-batch at a time."""

from __future__ import annotations

import os
from datetime import datetime, timedelta, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType(
    [
        T.StructField("event_time", T.TimestampType()),
        T.StructField("k", T.StringType()),
        T.StructField("q", T.LongType()),
        T.StructField("kafka_timestamp", T.TimestampType()),
    ]
)

# Micro-batches of "minute[:second] key"; the third holds only late rows.
GOLDEN = [
    ["01:00 a", "20:00 a"],
    ["21:00 a"],
    ["02:00 a", "03:00 a", "02:30 b", "09:30 a", "10:00 a"],
    ["40:00 a"],
    ["41:00 a"],
    ["29:00 b", "30:30 b"],
]


def at(text: str) -> datetime:
    minute, second = text.split(":")
    return datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=int(minute), seconds=int(second))


def rows(batch: list[str], arrival: str = "50:00"):
    return [(at(text.split()[0]), text.split()[1], 1, at(arrival)) for text in batch]


class Feed:
    """A folder of JSON lines files, one per micro-batch, in the order they were added."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = EVENT) -> None:
        self.spark, self.path, self.schema, self.added = spark, Path(path), schema, 0
        self.path.mkdir(parents=True, exist_ok=True)

    def add(self, batch) -> None:
        frame = self.spark.createDataFrame(batch, self.schema)
        lines = [row.value for row in frame.select(F.to_json(F.struct("*")).alias("value")).collect()]
        target = self.path / f"{self.added:04d}.json"
        target.write_text("\n".join(lines) + "\n")
        os.utime(target, (1_700_000_000 + self.added, 1_700_000_000 + self.added))
        self.added += 1

    def stream(self, files_per_trigger: int = 1) -> DataFrame:
        reader = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", files_per_trigger)
        return reader.json(str(self.path))

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).json(str(self.path))


def golden(spark: SparkSession, path: str) -> Feed:
    feed = Feed(spark, path)
    for batch in GOLDEN:
        feed.add(rows(batch))
    return feed
