"""Operator 7: sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked. A row's fractional rank is its rank, moved by a
seeded fraction of one that its source has, over the rows of the source. Sorted by it, the sources lie interleaved
in proportion, so that every cut of the order into equal runs has the mixture of the whole, to a few rows of a
source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.batches import shuffle_partitions
from millrace.llm.ranks import with_rank
from millrace.llm.registry import query

SHARDS = 16
SEED = 7


def interleaved_shards(
    df: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """Each row's id with ``size``, ``text_crc32``, ``shard`` and ``slot``; the shards' counts are at most one apart.

    Slots are the order within a shard, gapless from 0. A null source is a source; a null text is empty. Equal rows
    are ranked apart and may change places with each other, which leaves the result the same. Texts are read once
    and not shuffled; ranks are counted over buckets, so neither a large source nor the whole order is in one task.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = df.select(
        F.col(id_column).alias("id"),
        F.col(source_column).alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(F.lit(seed), F.col(id_column)).alias("shuffled"),
    )
    bits = max(1, (shuffle_partitions(df.sparkSession) - 1).bit_length())
    ties = ["shuffled", "id", "crc", "size"]
    ranked = with_rank(rows, ["source"], ties, "rank", f"shiftright(shuffled, {64 - bits})")
    counts = rows.groupBy(F.col("source").alias("of")).agg(F.count("*").alias("rows"))
    phase = F.pmod(F.xxhash64(F.lit(seed), F.lit("phase"), F.col("source")), F.lit(1 << 20)) / (1 << 20)
    spread = ranked.join(counts, F.col("source").eqNullSafe(F.col("of"))).withColumn("fraction", (F.col("rank") + phase) / F.col("rows"))
    ordered = with_rank(
        spread.select(*rows.columns, "fraction"), [], ["fraction", "source", *ties], "place", f"cast(floor(fraction * {1 << bits}) as int)"
    )
    total = rows.count()
    shard = F.expr(f"place * {shards} div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        ordered.withColumn("shard", shard)
        .withColumn("slot", F.col("place") - first)
        .select(F.col("id").alias(id_column), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), "slot")
    )


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen shards of equal counts."""
    placed = interleaved_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
