"""Small file operations on the file system Spark itself uses for a path (HDFS, object store, local)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: The writer of batches that no stream hands over.
DIRECT = "direct"


class SharedFiles:
    def __init__(self, spark: SparkSession) -> None:
        self._fs_package = spark._jvm.org.apache.hadoop.fs
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _open(self, path: str):
        target = self._fs_package.Path(path)
        return target.getFileSystem(self._conf), target

    def exists(self, path: str) -> bool:
        system, target = self._open(path)
        return system.exists(target)

    def make_folder(self, path: str) -> None:
        system, target = self._open(path)
        system.mkdirs(target)

    def names(self, path: str) -> list[str]:
        """Names directly below a folder; none if there is no such folder."""
        system, target = self._open(path)
        if not system.exists(target):
            return []
        return sorted(status.getPath().getName() for status in system.listStatus(target))

    def publish(self, staged: str, path: str) -> bool:
        """Move a finished folder to ``path`` unless that is there already: the first one stays."""
        system, target = self._open(path)
        source = self._fs_package.Path(staged)
        if system.exists(target) or not system.exists(source):
            return False
        system.mkdirs(target.getParent())
        if not system.rename(source, target):
            raise OSError(f"could not publish {staged} as {path}")
        return True

    def discard(self, path: str) -> None:
        system, target = self._open(path)
        system.delete(target, True)

    def read_json(self, path: str) -> dict | None:
        system, target = self._open(path)
        if not system.exists(target):
            return None
        stream = system.open(target)
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_json(self, path: str, content: dict, *, keep: bool = False) -> bool:
        """Write a small file so that it appears whole or not at all; with ``keep`` one that is there already stays."""
        system, target = self._open(path)
        if keep and system.exists(target):
            return False
        draft = self._fs_package.Path(target.getParent(), f"_{target.getName()}.{uuid.uuid4().hex}.draft")
        stream = system.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(content), "utf-8"))
        finally:
            stream.close()
        if not system.rename(draft, target):
            system.delete(draft, False)
            if keep and system.exists(target):
                return False
            raise OSError(f"could not write {path}")
        return True


def writer_of(batch: DataFrame) -> str:
    """Who publishes a micro-batch: the id of its streaming query, which stays while the checkpoint stays."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or DIRECT


def generation_of(files: SharedFiles, root: str, writer: str) -> int:
    """The number of a writer below ``root``; a new one gets the next number, so that its batches are its own.

    Batch numbers begin at 0 again with every new checkpoint: without the writer they say nothing.
    """
    for _ in range(100):
        known = {files.read_json(f"{root}/_writers/{name}")["writer"]: int(name) for name in files.names(f"{root}/_writers") if name.isdigit()}
        if writer in known:
            return known[writer]
        files.write_json(f"{root}/_writers/{max(known.values(), default=-1) + 1}", {"writer": writer}, keep=True)
    raise OSError(f"no number for a new writer below {root}")


def publish_batch(
    batch: DataFrame, folder: str, batch_id: int, *, root: str, writer: str | None = None, partition_by: Sequence[str] = ()
) -> None:
    """Write one micro-batch as ``folder/generation=g/batch_id=n``; a batch its writer repeats changes nothing.

    ``root`` holds the writers' numbers. Readers never see a half-written batch where renaming a folder is atomic,
    as on HDFS. On object stores use a table format instead.
    """
    files = SharedFiles(batch.sparkSession)
    generation = generation_of(files, root, writer or writer_of(batch))
    target = f"{folder}/generation={generation}/batch_id={batch_id}"
    staged = f"{folder}/_staging/{generation}-{batch_id}"
    if files.exists(target):
        return
    batch.write.mode("overwrite").partitionBy(*partition_by).parquet(staged)
    if not files.publish(staged, target):
        raise OSError(f"{target} was published by another attempt at the same time")
