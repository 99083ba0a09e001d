"""Operator 6: byte-level BPE encoding and decoding of documents."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.batches import map_batches
from millrace.llm.byte_bpe import byte_bpe
from millrace.llm.registry import query

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = VOCABULARY) -> DataFrame:
    """One row per row of ``df``: its id, and the ids of its text as little-endian unsigned 32-bit integers.

    A null text counts as empty and has no ids. Repeated rows give repeated rows, other columns are not looked at.
    Each task works on Arrow batches and holds one batch and a bounded cache of words.
    """

    def start():
        bpe = byte_bpe(path)

        def each(batch: pa.RecordBatch):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield row, bpe.encode(text or "")

        return each

    kind = df.schema[id_column].dataType.simpleString()
    return map_batches(df, [df[id_column], df[text_column]], f"`{id_column}` {kind}, ids binary", start)


def decode_documents(df: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", path: str = VOCABULARY) -> DataFrame:
    """The texts of packed ids, special tokens included; null ids count as none and give the empty text."""

    def start():
        bpe = byte_bpe(path)

        def each(batch: pa.RecordBatch):
            for row, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield row, bpe.decode(ids or b"")

        return each

    kind = df.schema[id_column].dataType.simpleString()
    return map_batches(df, [df[id_column], df[ids_column]], f"`{id_column}` {kind}, text string", start)


def _round_trip(path: str):
    def start():
        bpe = byte_bpe(path)

        def each(batch: pa.RecordBatch):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = bpe.encode(text or "")
                decoded = bpe.decode(ids)
                yield row, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

        return each

    return start


@query("op6_bpe_encoding")
def op6_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the text decoded from them, as digests; both directions in one pass over a batch."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return map_batches(
        documents,
        [documents["doc_id"], documents["text"]],
        "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
        _round_trip(VOCABULARY),
    )
