"""Ranks within groups of any size, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.batches import shuffle_partitions


def with_rank(df: DataFrame, group: list[str], order: list[str], name: str, bucket: str | None = None) -> DataFrame:
    """``df`` with a rank from 0 per group, gapless, as column ``name``.

    Rows are dealt over buckets per group; buckets are counted, and a row's rank is the rows in buckets before its
    own plus its place in its bucket by ``order``. Buckets are by hash of ``order`` unless ``bucket``, an expression
    that never falls as ``order`` rises, makes the ranks follow that order. Null is a group like any other.
    """
    buckets = shuffle_partitions(df.sparkSession)
    by_hash = F.pmod(F.xxhash64(*order), F.lit(buckets))
    spread = df.withColumn("_bucket", F.expr(bucket) if bucket else by_hash)
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        spread.groupBy(*keys)
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .select(*[F.col(key).alias(f"_of_{key}") for key in keys], "_before")
    )
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    same = [F.col(key).eqNullSafe(F.col(f"_of_{key}")) for key in keys]
    numbered = spread.withColumn("_place", place).join(starts, same)
    return numbered.withColumn(name, F.col("_before") + F.col("_place")).select(*df.columns, name)
