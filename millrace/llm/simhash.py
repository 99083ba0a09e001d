"""Operator 8: SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits falls into three segments. Two fingerprints that differ in at most two bits agree in one
segment at least, and in the next segment they differ in at most two bits. The binary Golay code of length 23 is
perfect: every word is within three bits of exactly one codeword. The codewords nearest to a segment and to all its
one-bit neighbours are one or six; segments at most two bits apart share one, that of a word between them. So the
keys (segment, codeword near the next segment) bring every pair of linked fingerprints together; a join verifies.

Keys with more fingerprints than ``LARGE_KEY`` are not joined with themselves. Their fingerprints are keyed by their
64 one-bit neighbours and themselves: linked fingerprints share one such word, and all that share a word are linked
through it, 65 at most. This is exact as well, and linear in the size of the group.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.folders import stored
from millrace.llm.batches import find_package_in_workers, map_batches, unused_name
from millrace.llm.components import connected_components
from millrace.llm.registry import query

SEGMENTS = (22, 21, 21)
LARGE_KEY = 16
SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Fixed value: generator of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


@cache
def golay_indices() -> np.ndarray:
    """For each word of 23 bits, the number of the codeword nearest to it."""
    rest = np.arange(4096, dtype=np.int64) << 11
    codewords = rest.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - 11)), rest)
    codewords |= rest
    ones = [1 << k for k in range(23)]
    errors = [0, *ones]
    errors += [a | b for i, a in enumerate(ones) for b in ones[i + 1 :]]
    errors += [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[i + 1 :], i + 1) for c in ones[j + 1 :]]
    nearest = np.empty(1 << 23, np.int16)
    for error in errors:
        nearest[codewords ^ error] = np.arange(4096)
    return nearest


def segments(fingerprints: np.ndarray) -> list[np.ndarray]:
    """The segments of unsigned 64-bit fingerprints, lowest bits first."""
    found, shift = [], 0
    for width in SEGMENTS:
        found.append((fingerprints >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64))
        shift += width
    return found


def keys_of(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: per segment, its value with each codeword near the next segment, each once."""
    nearest, parts = golay_indices(), segments(fingerprints)
    rows, keys = [], []
    for k, part in enumerate(parts):
        other = (k + 1) % len(parts)
        words = parts[other][:, None] ^ np.array([0, *(1 << bit for bit in range(SEGMENTS[other]))])
        near = np.sort(nearest[words], axis=1)
        new = np.concatenate([np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
        row, column = np.nonzero(new)
        rows.append(row)
        keys.append(k << 34 | part[row] << 12 | near[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint_of(text: str | None) -> int:
    """Unsigned 64-bit SimHash of the 3-word shingles of a text, A-Z in lower case; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, ones, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - SHINGLE + 1
    for begin in range(0, total, 1 << 16):
        part = words[begin : begin + (1 << 16) + SHINGLE - 1]
        hashes = [digest(a + b" " + b + b" " + c, SEED) for a, b, c in zip(part, part[1:], part[2:], strict=False)]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``fingerprint`` (bigint, its 64 bits) of each row of ``df``, beside its id and ``text_hash``; a null text has no words."""

    def start():
        def each(batch: pa.RecordBatch):
            for row, digest, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                found = fingerprint_of(text)
                yield row, digest, found - (1 << 64) if found >> 63 else found

        return each

    kind = df.schema[id_column].dataType.simpleString()
    columns = [df[id_column], F.xxhash64(df[text_column]), df[text_column]]
    return map_batches(df, columns, f"`{id_column}` {kind}, text_hash bigint, fingerprint bigint", start)


def fingerprint_keys(distinct: DataFrame) -> DataFrame:
    """``key, fingerprint``: the keys of each fingerprint, up to eighteen."""
    find_package_in_workers(distinct.sparkSession)

    def run(batches):
        for batch in batches:
            held = batch.column(0).to_numpy(zero_copy_only=False)
            for begin in range(0, len(held), 1 << 14):
                mine = held[begin : begin + (1 << 14)]
                rows, keys = keys_of(mine.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(mine[rows], pa.int64())], ["key", "fingerprint"])

    return distinct.select("fingerprint").mapInArrow(run, "key bigint, fingerprint bigint")


def fingerprint_links(distinct: DataFrame, large_key: int = LARGE_KEY) -> DataFrame:
    """Links ``a, b`` that connect all fingerprints at most two bits apart; ``distinct`` has each fingerprint once.

    Of large keys not every pair is a row, but all that such a row would connect is connected.
    """
    keys = fingerprint_keys(distinct)
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(keys.join(sizes, "key"))
    small = shared.where(F.col("size") <= large_key)
    left = small.select("key", F.col("fingerprint").alias("a"))
    right = small.select(F.col("key").alias("same"), F.col("fingerprint").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = left.join(right, (F.col("key") == F.col("same")) & (F.col("a") < F.col("b")) & near).select("a", "b")
    neighbours = F.expr(
        "explode(concat(array(fingerprint), transform(sequence(0, 63), bit -> fingerprint ^ shiftleft(1L, bit))))"
    )
    crowded = shared.where(F.col("size") > large_key).select("fingerprint").distinct().select("fingerprint", neighbours.alias("word"))
    groups = crowded.groupBy("word").agg(F.collect_list("fingerprint").alias("members")).where("size(members) > 1")
    stars = groups.select(F.explode("members").alias("a"), F.array_min("members").alias("b")).where("a <> b")
    return pairs.union(stars)


def near_duplicate_groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", large_key: int = LARGE_KEY) -> DataFrame:
    """One row per row of ``df``: its id, ``text_hash``, ``fingerprint``, ``component`` and ``component_id``, the smallest id in it.

    Texts without words share the fingerprint zero and are linked like any other; copies have one fingerprint, which
    is looked at once. Rows without an id take part; a component that has none but them has no id.
    """
    rows = stored(fingerprints(df, id_column, text_column))
    distinct = stored(rows.groupBy("fingerprint").agg(F.min(id_column).alias("first")))
    found = connected_components(fingerprint_links(distinct, large_key))
    member = distinct.join(found, distinct["fingerprint"] == found["node"], "left")
    member = member.select("fingerprint", "first", F.coalesce("component", "fingerprint").alias("component"))
    names = member.groupBy(F.col("component").alias("of")).agg(F.min("first").alias("component_id"))
    named = stored(member.join(names, F.col("component") == F.col("of")).select(F.col("fingerprint").alias("print"), "component", "component_id"))
    return rows.join(named, rows["fingerprint"] == named["print"]).select(id_column, "text_hash", "fingerprint", "component", "component_id")


def one_of_each(df: DataFrame, groups: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of ``df`` per component of ``groups``, which has ``text_hash`` and ``component`` of each row: that of the
    smallest id, of rows with one id that of the smallest hash. Rows without an id stay where there are no others."""
    first = F.min(F.struct(F.isnull(id_column).alias("last"), F.col(id_column).alias("id"), "text_hash"))
    chosen = groups.groupBy("component").agg(first.alias("first")).select(F.col("first.id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    own = unused_name(df, "_text_hash")
    hashed = df.withColumn(own, F.xxhash64(text_column))
    same = (hashed[own] == chosen["_hash"]) & hashed[id_column].eqNullSafe(chosen["_id"])
    return hashed.join(chosen, same, "left_semi").dropDuplicates([id_column, own]).drop(own)


@query("op8_simhash_near_dedup")
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents, the fingerprint as 16 lower-case hex digits."""
    groups = near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
