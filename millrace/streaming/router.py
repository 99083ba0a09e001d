"""The late router: every event of a stream goes to the on-time log, the late log or quarantine."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from millrace.functions.durations import to_micros
from millrace.operators.decode import MISSING, wrong_time
from millrace.operators.late import LATE_REASON, enrich_late, with_late_metadata
from millrace.operators.windows import DATE_COLUMN, utc_date
from millrace.streaming.files import SharedFiles, writer_of
from millrace.streaming.triggers import AVAILABLE_NOW, triggered

ON_TIME, LATE, QUARANTINE = "on_time", "late", "quarantine"
WAITING = "waiting"
#: Under this name a reader's progress reports the last batch it has read.
READ_METRIC = "router_batches"
#: Records of older batches are removed; only that of the last one is ever needed.
MARKS_KEPT = 100
_LATE_COLUMNS = ("arrival_time", "lateness_seconds", "lateness_class", "_late_metadata")
_QUARANTINE_COLUMNS = ("quarantine_reason", "raw_value")


class LateRouter:
    """Splits a stream under ``root`` and keeps all of it.

    Spark drops late rows inside its stateful operators without showing them, so the split happens before. For
    batch *n* the watermark is the latest event time of batches before *n*, less ``delay``. The latest event time
    of each finished batch is kept in a small file, and the decision for *n* uses only the file of *n - 1*: a
    repeated batch is split alike. The batch is written once, partitioned by side, and each side then appears by
    one rename, unless an earlier attempt has put it there.

    An event is late if it is older than the watermark. That is stricter than Spark's own rule (by window end,
    one batch later), so an aggregate over the on-time log with the same delay drops nothing. Late events are
    not lost either: ``reprocess`` adds them to the windows they belong to.

    An event whose time is more than ``max_ahead`` after its arrival (``max_behind`` before it) has it from a wrong
    clock: it goes to quarantine and does not move the watermark. So no event can be more than that and the delay
    ahead of the others, and the dates of the logs are as many as the bounds allow.

    The logs are partitioned by ``utc_date`` of the event time, for ``reprocess``. A stream over the on-time log must read
    whole batches: part of one would move the watermark past the rest. To bound what such a stream reads at once, give
    ``release``: batches then wait until the reader has come so far that no more than so many are unread. How far that
    is, is told by ``note_read``; ``follow`` does so for a running query by what its progress reports.

    Every task that read a part of the batch writes a file per side. Where that makes many small files of late
    events, ``sized_files`` shuffles the batch into files of even size first (with adaptive execution).

    One router writes to a root, with one checkpoint; another one is refused. Renaming must be atomic (HDFS; not object stores).
    """

    def __init__(
        self,
        root: str,
        *,
        delay: str = "10 minutes",
        max_lateness: str = "1 hour",
        time_column: str = "event_time",
        arrival_column: str = "kafka_timestamp",
        reason: str = LATE_REASON,
        sized_files: bool = False,
        release: int | None = None,
        max_ahead: str | None = "1 day",
        max_behind: str | None = None,
    ) -> None:
        if release is not None and release < 1:
            raise ValueError("at least one batch is released at a time")
        self.release_batches = release
        self.root = root.rstrip("/")
        self.delay_micros = to_micros(delay)
        to_micros(max_lateness)
        self.max_lateness = max_lateness
        self.time_column = time_column
        self.arrival_column = arrival_column
        self.reason = reason
        self.sized_files = sized_files
        self.max_ahead, self.max_behind = max_ahead, max_behind
        for bound in filter(None, (max_ahead, max_behind)):
            to_micros(bound)

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/_checkpoint"

    def path(self, side: str) -> str:
        return f"{self.root}/{side}"

    def start(self, events: DataFrame, trigger: dict | None = None) -> StreamingQuery:
        """Route a stream of events; of ``decode_checked`` rows the bad ones go to quarantine."""
        files = SharedFiles(events.sparkSession)
        for side in (ON_TIME, LATE, QUARANTINE):
            files.make_folder(self.path(side))

        def route(batch: DataFrame, batch_id: int) -> None:
            self.route_batch(batch, batch_id)
            self.release(batch.sparkSession)

        writer = events.writeStream.foreachBatch(route).option("checkpointLocation", self.checkpoint)
        return triggered(writer, trigger).start()

    def route_batch(self, batch: DataFrame, batch_id: int) -> None:
        files = SharedFiles(batch.sparkSession)
        self._refuse_other_writers(files, writer_of(batch))
        if files.exists(self._mark(batch_id)):
            return
        prior = self._prior_high(files, batch_id)
        staged = f"{self.root}/_staging/{batch_id}"
        seen = Observation()
        routable = F.when(F.col("__side") != QUARANTINE, F.unix_micros(F.col(self.time_column).cast("timestamp")))
        sided = self._sided(batch, prior).observe(seen, F.max(routable).alias("high"))
        if self.sized_files:
            sided = sided.hint("rebalance")
        if DATE_COLUMN in sided.columns:
            raise ValueError(f"events have a column {DATE_COLUMN!r}, by which the logs are partitioned")
        dated = sided.withColumn(DATE_COLUMN, utc_date(sided, self.time_column))
        dated.write.mode("overwrite").partitionBy("__side", DATE_COLUMN).parquet(staged)
        for side in (ON_TIME, LATE, QUARANTINE):
            waits = side == ON_TIME and self.release_batches is not None
            if waits and files.exists(f"{self.path(ON_TIME)}/batch_id={batch_id}"):
                continue
            files.publish(f"{staged}/__side={side}", f"{self.path(WAITING if waits else side)}/batch_id={batch_id}")
        highs = [high for high in (prior, seen.get["high"]) if high is not None]
        files.write_json(self._mark(batch_id), {"prior": prior, "high": max(highs, default=None)})
        files.discard(staged)
        files.discard(self._mark(batch_id - MARKS_KEPT))

    def release(self, spark: SparkSession) -> int:
        """Put the oldest waiting batches into the on-time log, so that no more than ``release`` of it are unread, and
        say how many were put there."""
        if self.release_batches is None:
            return 0
        files, read = SharedFiles(spark), self._read_upto(spark)
        unread = sum(batch_id > read for batch_id in _batches(files, self.path(ON_TIME)))
        ready = _batches(files, self.path(WAITING))[: max(0, self.release_batches - unread)]
        for batch_id in ready:
            files.publish(f"{self.path(WAITING)}/batch_id={batch_id}", f"{self.path(ON_TIME)}/batch_id={batch_id}")
        return len(ready)

    def waiting(self, spark: SparkSession) -> int:
        """How many batches have not been released."""
        return len(_batches(SharedFiles(spark), self.path(WAITING)))

    def note_read(self, spark: SparkSession, upto: int | None = None) -> None:
        """The reader of the on-time log has finished batches up to ``upto``, by default all that are there."""
        files = SharedFiles(spark)
        upto = max(_batches(files, self.path(ON_TIME)), default=-1) if upto is None else upto
        before = [int(name) for name in files.names(f"{self.root}/_read") if name.isdigit()]
        if upto > max(before, default=-1):
            files.write_json(f"{self.root}/_read/{upto}", {"read": upto}, keep=True)
            for number in before:
                files.discard(f"{self.root}/_read/{number}")

    def _read_upto(self, spark: SparkSession) -> int:
        return max((int(name) for name in SharedFiles(spark).names(f"{self.root}/_read") if name.isdigit()), default=-1)

    def follow(self, spark: SparkSession) -> ReaderPace:
        """Release batches at the pace of a query over ``on_time_stream``: tell it with ``ReaderPace.of`` once it runs."""
        pace = ReaderPace(spark, self)
        spark.streams.addListener(pace)
        return pace

    def _read(self, spark: SparkSession, side: str, fields: list[T.StructField]) -> DataFrame:
        return spark.read.schema(T.StructType([*fields, _BATCH_ID, _DATE])).parquet(self.path(side))

    def _refuse_other_writers(self, files: SharedFiles, writer: str) -> None:
        """Batch numbers of another query mean other batches: taking them for repeated ones would lose events."""
        record = f"{self.root}/_writer.json"
        files.write_json(record, {"writer": writer}, keep=True)
        if (owner := files.read_json(record)["writer"]) != writer:
            raise ValueError(
                f"{self.root} belongs to another checkpoint (query {owner}, not {writer}); restore {self.checkpoint} "
                "or route to a new root"
            )

    def _mark(self, batch_id: int) -> str:
        return f"{self.root}/_marks/{batch_id}.json"

    def _prior_high(self, files: SharedFiles, batch_id: int) -> int | None:
        if batch_id == 0:
            return None
        mark = files.read_json(self._mark(batch_id - 1))
        if mark is None:
            raise ValueError(f"{self.root} has no record of batch {batch_id - 1}: it belongs to another checkpoint")
        return mark["high"]

    def _sided(self, batch: DataFrame, prior: int | None) -> DataFrame:
        rows = batch
        if "quarantine_reason" not in rows.columns:
            rows = rows.withColumn("quarantine_reason", F.lit(None).cast("string"))
        no_time = F.when(F.col(self.time_column).isNull(), MISSING)
        wrong = wrong_time(F.col(self.time_column), F.col(self.arrival_column), self.max_ahead, self.max_behind)
        rows = rows.withColumn("quarantine_reason", F.coalesce("quarantine_reason", no_time, wrong))
        if prior is None:
            late: Column = F.lit(False)
        else:
            late = F.col(self.time_column) < F.timestamp_micros(F.lit(prior - self.delay_micros))
        side = F.when(F.col("quarantine_reason").isNotNull(), QUARANTINE).when(late, LATE).otherwise(ON_TIME)
        described = enrich_late(
            rows.withColumn("__side", side),
            time_column=self.time_column,
            arrival_column=self.arrival_column,
            max_lateness=self.max_lateness,
            reason=self.reason,
        )
        only_late = {name: F.when(F.col("__side") == LATE, F.col(name)) for name in _LATE_COLUMNS}
        return described.withColumns(only_late)

    def on_time_stream(self, spark: SparkSession, schema: T.StructType, *, with_batch: bool = False, **options: str) -> DataFrame:
        """The on-time log as a stream, in batch order; each run reads all that is released.

        ``with_batch`` keeps ``batch_id``: the greatest one among the events of a result tells how much of the log the
        result has seen.
        """
        if limits := {name for name in options if name.lower() in ("maxfilespertrigger", "maxbytespertrigger")}:
            raise ValueError(f"{sorted(limits)} would take batches apart and lose events; let the router release batches")
        wanted = [field for field in schema.fields if field.name not in _QUARANTINE_COLUMNS]
        # The partition columns are named, or a stream begun over an empty log would not know them.
        stream = spark.readStream.schema(T.StructType([*wanted, _BATCH_ID, _DATE])).options(**options)
        read = stream.parquet(self.path(ON_TIME)).observe(READ_METRIC, F.max(_BATCH_ID.name).alias("read"))
        return read.drop(_DATE.name) if with_batch else read.drop(_BATCH_ID.name, _DATE.name)

    def late_stream(self, spark: SparkSession, schema: T.StructType, **options: str) -> DataFrame:
        """The side output as a stream, for example to a topic of late events."""
        wanted = [field for field in schema.fields if field.name not in _QUARANTINE_COLUMNS]
        stream = spark.readStream.schema(T.StructType([*wanted, *_LATE_FIELDS, _BATCH_ID, _DATE])).options(**options)
        return stream.parquet(self.path(LATE)).drop(_BATCH_ID.name, _DATE.name)

    def read_on_time(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        wanted = [field for field in schema.fields if field.name not in _QUARANTINE_COLUMNS]
        return self._read(spark, ON_TIME, wanted)

    def read_late(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """The side output: the event columns and what is known of the lateness."""
        wanted = [field for field in schema.fields if field.name not in _QUARANTINE_COLUMNS]
        return self._read(spark, LATE, [*wanted, *_LATE_FIELDS])

    def read_quarantine(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        reason = [] if "quarantine_reason" in schema.names else [T.StructField("quarantine_reason", T.StringType())]
        return self._read(spark, QUARANTINE, [*schema.fields, *reason])


class ReaderPace(StreamingQueryListener):
    """Tells a router how far the query over its on-time log has come, after each of its micro-batches.

    A query that was ended between a commit and its report has read more than was noted. It then finds nothing new:
    when it has been idle since a moment at which the log was looked at, it has read what was there.
    """

    def __init__(self, spark: SparkSession, router: LateRouter) -> None:
        self.spark, self.router = spark, router
        self.query: str | None = None
        self._looked: tuple[datetime, int] | None = None

    def of(self, query: StreamingQuery) -> None:
        self.query = query.id

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) != self.query:
            return
        self._looked = None
        reported = event.progress.observedMetrics.get(READ_METRIC)
        if reported is not None and reported["read"] is not None:
            self._advance(reported["read"])

    def onQueryIdle(self, event) -> None:
        if str(event.id) != self.query:
            return
        at = datetime.fromisoformat(event.timestamp.replace("Z", "+00:00"))
        if self._looked is not None and at > self._looked[0]:
            self._advance(self._looked[1])
        there = _batches(SharedFiles(self.spark), self.router.path(ON_TIME))
        self._looked = (datetime.now(timezone.utc), max(there, default=-1))

    def onQueryTerminated(self, event) -> None:
        pass

    def _advance(self, upto: int) -> None:
        self.router.note_read(self.spark, upto)
        self.router.release(self.spark)


def _batches(files: SharedFiles, folder: str) -> list[int]:
    return sorted(int(name.removeprefix("batch_id=")) for name in files.names(folder) if name.startswith("batch_id="))


_BATCH_ID = T.StructField("batch_id", T.LongType())
_DATE = T.StructField(DATE_COLUMN, T.DateType())
_LATE_FIELDS = (
    T.StructField("arrival_time", T.TimestampType()),
    T.StructField("lateness_seconds", T.LongType()),
    T.StructField("lateness_class", T.StringType()),
    T.StructField(
        "_late_metadata",
        T.StructType([T.StructField("routed_at", T.TimestampType()), T.StructField("reason", T.StringType())]),
    ),
)


def write_late_events(
    late: DataFrame, side_output_path: str, checkpoint: str, *, trigger: dict | None = None, reason: str = LATE_REASON
) -> StreamingQuery:
    """Append a stream of events already known to be late to a side output, marked as such.

    The checkpoint must lie outside the data, or readers of the folder would come upon it.
    """
    inside = checkpoint.rstrip("/") + "/"
    if inside.startswith(side_output_path.rstrip("/") + "/"):
        raise ValueError("keep the checkpoint outside the side output folder")
    writer = (
        with_late_metadata(late, reason=reason)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", side_output_path)
        .option("checkpointLocation", checkpoint)
    )
    return triggered(writer, trigger).start()
