"""Results that change: each micro-batch adds its new versions, readers take the newest per key."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.cdc import live_rows, newest_changes, split_changes
from millrace.streaming.files import SharedFiles, generation_of, publish_batch

_CORRECTED, _DELETED = "__corrected", "__deleted"
#: The column of results behind the late router that says up to which of its batches a result has seen events.
SEEN = "router_batch"
CORRECTIONS = "corrections"


class UpsertTable:
    """A parquet folder of batches, ``deltas/generation=g/batch_id=n``, read as the newest row per key.

    Every writer, told by the id of its streaming query, has a generation of its own: a batch that its writer
    repeats changes nothing, and a stream with a new checkpoint goes on above what the former one wrote.
    ``order_by`` tells which of two rows with equal ``keys`` is newer; by default the later generation and batch.
    With columns of the data, such as ``ts_ms, offset``, the order in which batches arrive does not matter.

    ``seen`` names a column that says how much of the log a row has seen. It comes before all else: the row that has
    seen more is newer, whoever wrote it, and of two that have seen as much a correction is. Only a table with such a
    column takes corrections. Nothing is ever merged or removed here; where the table grows for long, give the stream a
    catalog table instead (``merge_into``), whose format does that.
    """

    def __init__(
        self, path: str, keys: Sequence[str], order_by: Sequence[str] = ("generation", "batch_id"), *, seen: str | None = None
    ) -> None:
        if not keys:
            raise ValueError("an upsert needs key columns")
        self.path = path.rstrip("/")
        self.keys = list(keys)
        self.order_by = list(order_by)
        self.seen = seen

    def upsert_batch(self, batch: DataFrame, batch_id: int, *, deleted: str | None = None) -> None:
        """For ``foreachBatch``. A batch holds at most one row per key; those marked by the boolean column ``deleted``,
        which isn't kept, remove theirs."""
        gone = F.lit(False) if deleted is None else F.col(deleted)
        marked = batch.withColumns({_CORRECTED: F.lit(False), _DELETED: gone})
        self._publish(marked if deleted is None else marked.drop(deleted), batch_id)

    def apply_corrections(self, rows: DataFrame, deletes: DataFrame | None = None) -> None:
        """Rows that replace those with their keys, and keys to delete, in one step.

        A row stands above what has seen no more of the log than it has, and below what has seen more: a stream that goes
        on behind the late router writes an open window again, without the late events, and the next correction adds
        them once more. Keys to delete have seen as much as the rows that take their place, all of them.
        """
        if self.seen is None or self.seen not in rows.columns:
            raise ValueError("corrections need a column that tells how much of the log they have seen")
        changed = _with_deletes(rows, deletes, self.keys, self.seen).withColumn(_CORRECTED, F.lit(True))
        files = SharedFiles(rows.sparkSession)
        generation = generation_of(files, self.path, CORRECTIONS)
        done = [int(name.removeprefix("batch_id=")) for name in files.names(f"{self.path}/deltas/generation={generation}")]
        self._publish(changed, max(done, default=-1) + 1, CORRECTIONS)

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest row per key, without those deleted and without the column of what they have seen."""
        files, deltas = SharedFiles(spark), f"{self.path}/deltas"
        if not any(name.startswith("generation=") for name in files.names(deltas)):
            raise ValueError(f"nothing was written to {self.path} yet")
        versions = spark.read.parquet(deltas)
        versions = versions.withColumns({name: F.col(name).cast("long") for name in ("generation", "batch_id")})
        rest = [name for name in versions.columns if name not in self.keys]
        newest = F.max_by(F.struct(*rest), F.struct(*self._order())).alias("__newest")
        found = versions.groupBy(*self.keys).agg(newest).select(*self.keys, "__newest.*").where(~F.col(_DELETED))
        return found.drop("generation", "batch_id", _CORRECTED, _DELETED, *([self.seen] if self.seen else []))

    def _order(self) -> list[Column]:
        seen = [F.coalesce(F.col(self.seen), F.lit(-1)), F.col(_CORRECTED)] if self.seen else []
        return [*seen, *map(F.col, self.order_by)]

    def _publish(self, rows: DataFrame, batch_id: int, writer: str | None = None) -> None:
        publish_batch(rows, f"{self.path}/deltas", batch_id, root=self.path, writer=writer)


def _with_deletes(rows: DataFrame, deletes: DataFrame | None, keys: Sequence[str], seen: str) -> DataFrame:
    marked = rows.withColumn(_DELETED, F.lit(False))
    if deletes is None:
        return marked
    upto = rows.agg(F.max(seen).alias("seen")).first()["seen"]
    marks = {seen: F.lit(upto).cast(rows.schema[seen].dataType), _DELETED: F.lit(True)}
    return marked.unionByName(deletes.select(*keys).withColumns(marks), allowMissingColumns=True)


def merge_corrections(table: str, keys: Sequence[str], seen: str, rows: DataFrame, deletes: DataFrame | None = None) -> None:
    """``UpsertTable.apply_corrections`` for a catalog table whose format supports MERGE."""
    merge_into(table, keys, seen=seen, deleted=_DELETED)(_with_deletes(rows, deletes, keys, seen), 0)


def merge_into(table: str, keys: Sequence[str], *, seen: str | None = None, deleted: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that upserts into a catalog table whose format supports MERGE.

    A repeated batch merges the same rows again and leaves the table as it was. Where a row is there already, ``seen``
    lets only a row replace it that has seen as much of the log, or more; so corrections are merged by the same function.
    Rows marked by the boolean column ``deleted`` remove their keys; the table has no such column.
    """

    def merge(batch: DataFrame, _batch_id: int) -> None:
        source = batch.alias("source")
        matches = [F.col(f"target.{key}").eqNullSafe(F.col(f"source.{key}")) for key in keys]
        condition = matches[0]
        for match in matches[1:]:
            condition = condition & match
        newer = None if seen is None else F.coalesce(F.col(f"source.{seen}") >= F.col(f"target.{seen}"), F.lit(True))
        merging = source.mergeInto(table, condition)
        if deleted is None:
            matched = merging.whenMatched() if newer is None else merging.whenMatched(newer)
            matched.updateAll().whenNotMatched().insertAll().merge()
            return
        gone = F.coalesce(F.col(f"source.{deleted}"), F.lit(False))
        values = {name: F.col(f"source.{name}") for name in batch.columns if name != deleted}
        merging = merging.whenMatched(gone if newer is None else gone & newer).delete()
        merging = (merging.whenMatched() if newer is None else merging.whenMatched(newer)).update(values)
        merging.whenNotMatched(~gone).insert(values).merge()

    if not keys:
        raise ValueError("an upsert needs key columns")
    return merge


class ChangeTable:
    """The current rows of the source tables of a change stream.

    Each micro-batch is reduced to the newest change per key and appended; a read takes the newest of all
    batches by change time and offset and leaves deleted rows out. No state is held between batches, deletes
    stay on record so that an older update cannot bring a row back, and batches may come in any order. Changes
    that ``split_changes`` finds bad go to ``quarantine``; give it ``decode_changes_checked`` rows, or a value of a
    wrong type is taken for null.
    """

    def __init__(self, path: str, key: str = "id") -> None:
        self.key = key
        self.changes = UpsertTable(path, ["source_table", "row_key"], ["ts_ms", "offset"])

    def apply_batch(self, changes: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch`` over decoded changes."""
        changes.persist()
        try:
            bad = split_changes(changes, self.key)[1]
            publish_batch(bad, f"{self.changes.path}/quarantine", batch_id, root=self.changes.path)
            self.changes.upsert_batch(newest_changes(changes, self.key), batch_id)
        finally:
            changes.unpersist()

    def read(self, spark: SparkSession) -> DataFrame:
        return live_rows(self.changes.read(spark))
