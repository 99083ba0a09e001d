"""Duplicates that come long after the watermark: filters of the ids of each day, and an exact look at the hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.folders import remove_stored, stored
from millrace.operators.broadcasts import BROADCAST_ROWS, anti_join, semi_join
from millrace.operators.dedup import deduplicate
from millrace.operators.windows import utc_date
from millrace.streaming.files import SharedFiles, generation_of, publish_batch, writer_of

DATE = "seen_date"
#: Bits of a day's filter; 8 for each event of a day let one in eight of the others pass to the exact look.
DAY_BITS = 1 << 20


class UniqueEvents:
    """A log of events without repeats, below ``root``; what was seen in the last ``days`` is known.

    Spark's own removal of duplicates keeps every id in the state until the watermark has passed it, so it is for copies
    that come soon. Here each day of arrival has a Bloom filter of its ids, as rows of 64 bits. A micro-batch is
    held against the filters of the last ``days``; only ids that are in one, and only the days they are in, are looked up
    in the log itself. So nothing is kept but the log and filters of bounded size, and no event is taken for a copy that
    is none. A copy that comes later than ``days`` counts as an event of its own; filters older than that are not read.
    Events without arrival time are of no day: copies of them are found within a batch alone.

    Batches are told apart by writer and number; a repeated one changes nothing. ``bits`` must stay the same for a root.
    """

    def __init__(self, root: str, keys: Sequence[str], *, days: int = 30, arrival_column: str = "kafka_timestamp", bits: int = DAY_BITS) -> None:
        if not keys or days < 0 or bits < 64 or bits & (bits - 1):
            raise ValueError("keys, days and a power of two of bits are needed")
        self.root, self.keys, self.days, self.arrival_column, self.bits = root.rstrip("/"), list(keys), days, arrival_column, bits

    @property
    def events(self) -> str:
        return f"{self.root}/events"

    @property
    def filters(self) -> str:
        return f"{self.root}/filters"

    def apply_batch(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``: add the events that are new. Of copies within a batch the one that arrived first stays."""
        files = SharedFiles(batch.sparkSession)
        place = f"generation={generation_of(files, self.root, writer_of(batch))}/batch_id={batch_id}"
        if not files.exists(f"{self.events}/{place}"):
            first = deduplicate(batch, self.keys, first_by=[self.arrival_column])
            held = [stored(first.withColumn(DATE, utc_date(first, self.arrival_column)))]
            publish_batch(self._new(held), self.events, batch_id, root=self.root, writer=writer_of(batch), partition_by=[DATE])
            for table in held:
                remove_stored(table)
        added = batch.sparkSession.read.schema(_dated(batch)).parquet(f"{self.events}/{place}")
        # Made of what was published, so that an attempt that was cut short between the two is completed alike.
        publish_batch(self._filter(added), self.filters, batch_id, root=self.root, writer=writer_of(batch), partition_by=[DATE])

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.events).drop("generation", "batch_id", DATE)

    def _at(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.bits))

    def _filter(self, events: DataFrame) -> DataFrame:
        placed = events.select(DATE, self._at().alias("at"))
        words = placed.groupBy(DATE, (F.col("at") - F.pmod("at", F.lit(64))).alias("word"))
        return words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))

    def _new(self, held: list[DataFrame]) -> DataFrame:
        """The events of the first table held that were not seen; tables it needs on the way are added to those held."""
        dated = held[0]
        spark = dated.sparkSession
        arrived = dated.agg(F.min(DATE).alias("low"), F.max(DATE).alias("high")).first()
        if arrived["low"] is None or not any(name.startswith("generation=") for name in SharedFiles(spark).names(self.filters)):
            return dated
        near = F.col(DATE).between(F.date_sub(F.lit(arrived["low"]), self.days), F.lit(arrived["high"]))
        old = spark.read.parquet(self.filters).where(near)
        old = old.groupBy(F.col(DATE).alias("day"), F.col("word").alias("of_word")).agg(F.bit_or("bits").alias("day_bits"))
        rows = old.count()
        asked = dated.select(*self.keys, self._at().alias("at"))
        asked = asked.withColumn("word", F.col("at") - F.pmod("at", F.lit(64)))
        found = asked.join(F.broadcast(old) if rows <= BROADCAST_ROWS else old, F.col("word") == F.col("of_word"))
        hits = stored(found.where("(shiftright(day_bits, cast(at % 64 as int)) & 1) = 1").select(*self.keys, "day"))
        days = [row["day"] for row in hits.select("day").distinct().collect()]
        names = {key: f"__hit_{key}" for key in self.keys}
        asked_for = hits.select(*[F.col(key).alias(name) for key, name in names.items()]).distinct()
        there = spark.read.parquet(self.events).where(F.col(DATE).isin(days)).select(*self.keys)
        seen = semi_join(there, asked_for, names, rows=asked_for.count())
        copies = stored(seen.select(*[F.col(key).alias(name) for key, name in names.items()]).distinct())
        held += [hits, copies]
        return anti_join(dated, copies, names, rows=copies.count())


def _dated(batch: DataFrame):
    return T.StructType([*batch.schema.fields, T.StructField(DATE, T.DateType())])
