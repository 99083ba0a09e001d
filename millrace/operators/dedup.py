"""Removal of events delivered more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def deduplicate(
    df: DataFrame, keys: Sequence[str] = ("order_id",), *, first_by: Sequence[str] = (), salts: int = 8
) -> DataFrame:
    """One event per ``keys``.

    On a stream with a watermark, copies that arrive within the watermark delay are removed, and state is dropped
    with the watermark. Spark brings all copies of a key to one task, so they are thinned out first: copies are
    dealt over ``salts`` groups by the task that read them, and one of each group goes on. With one salt, where no
    key has many copies, that step and its state are saved.

    On a table, the copy least by ``first_by`` is kept, of equal ones that least by its other columns, as far as they
    can be ordered; without ``first_by``, copies must be alike and any may stay. Copies are combined map side before the shuffle.
    """
    if df.isStreaming:
        if salts > 1:
            dealt = df.withColumn("__salt", F.spark_partition_id() % salts)
            df = dealt.dropDuplicatesWithinWatermark([*keys, "__salt"]).drop("__salt")
        return df.dropDuplicatesWithinWatermark(list(keys))
    rest = [name for name in df.columns if name not in keys]
    if not first_by or not rest:
        return df.dropDuplicates(list(keys))
    ordered = [name for name in rest if name not in first_by and orderable(df.schema[name].dataType)]
    kept = F.min_by(F.struct(*rest), F.struct(*first_by, *ordered)).alias("__kept")
    return df.groupBy(*keys).agg(kept).select(*keys, "__kept.*").select(*df.columns)


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(orderable(field.dataType) for field in kind.fields)
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    return not isinstance(kind, T.MapType | T.VariantType)
