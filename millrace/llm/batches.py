"""Helpers of operators that work on Arrow batches inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

OUTPUT_BYTES = 8 << 20
#: Rows that are Python objects at a time; the rest of an Arrow batch stays as it came.
ROWS_AT_A_TIME = 512


def shuffle_partitions(spark: SparkSession) -> int:
    """How many parts large intermediate data is dealt over: the cluster's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def find_package_in_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [root, *paths]))


def unused_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that no column of ``df`` is called so."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_batches(
    df: DataFrame,
    columns: list,
    schema: str,
    start: Callable[[], Callable[[pa.RecordBatch], Iterable[tuple]]],
) -> DataFrame:
    """``mapInArrow`` over the given columns, by a function that yields one tuple per row of the result.

    ``start`` is called once per task and returns the function for one part of a batch; if that has a ``finish``, its
    rows come last. Rows go in and leave in bounded numbers, so long texts do not pile up.
    """
    find_package_in_workers(df.sparkSession)
    parsed = _parse_datatype_string(schema)
    assert isinstance(parsed, StructType)
    arrow = to_arrow_schema(parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for part in parts_of(batches):
            yield from in_batches(each(part), arrow)
        if finish := getattr(each, "finish", None):
            yield from in_batches(finish(), arrow)

    return df.select(*columns).mapInArrow(run, parsed)


def filter_rows(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows of ``df``, all columns, that a function of a part of a batch says; ``start`` makes it once per task."""
    find_package_in_workers(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = start()
        for part in parts_of(batches):
            yield part.filter(pa.array(wanted(part), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def parts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
            yield batch.slice(at, ROWS_AT_A_TIME)


def in_batches(rows: Iterable[tuple], schema: pa.Schema, rows_per_batch: int = 4096) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches of at most so many rows and about ``OUTPUT_BYTES`` of strings and binaries."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes | str))
        if len(held) >= rows_per_batch or size >= OUTPUT_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, field.type) for column, field in zip(columns, schema, strict=True)], schema=schema
    )
