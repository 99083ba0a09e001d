"""Operator 3: packing tokenized documents into sequences by cutting-stock column generation.

A document becomes pieces: full sequences first, then what remains. Piece lengths, short ones as they are and longer
ones rounded up by a sixty-fourth at most, give a histogram of bounded size. A linear program over patterns (multisets
of lengths that fit a sequence) covers it with nearly as few sequences as possible; its columns come from a knapsack by
dynamic programming over the dual prices, first with all sizes in coarse units, then exactly. The rounded patterns say how many pieces of each length go to which run of sequences; pieces take these places by
their rank among the pieces of their length. Only the histogram reaches the driver.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.folders import stored
from millrace.llm.batches import find_package_in_workers, map_batches
from millrace.llm.byte_bpe import PATTERN, ByteBpe
from millrace.llm.ranks import with_rank
from millrace.llm.registry import query

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SEQUENCE = 2048
UNIT = 8
END_ID = 1
MOST_PIVOTS = 4000
#: The linear program ends when no pattern is worth this much more than a sequence: it is that near to the least number.
GAIN = 5e-4
#: After so many pivots the inverse is computed anew, as rounding errors pile up.
REFRESHED = 64
#: It ends as well when that many pivots saved less than this share of the sequences.
STALLED = 2e-5
#: Lengths below this are sizes of their own.
EXACT = 64


class LibraryBpe(ByteBpe):
    """The same ids with the merges left to a library; its ranks are the ids of the vocabulary file."""

    def __init__(self, path: str, cached_words: int = 100_000):
        super().__init__(path, cached_words)
        special = set(self.special.values())
        ranks = {token: token_id for token_id, token in self.bytes_of.items() if token_id not in special}
        self.library = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _chunk(self, chunk: str) -> bytes:
        return self._packed(self.library.encode_ordinary(chunk))


@cache
def library_bpe(path: str) -> LibraryBpe:
    return LibraryBpe(path)


def token_pieces(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    path: str = VOCABULARY,
    sequence: int = SEQUENCE,
    end_id: int = END_ID,
) -> DataFrame:
    """Each text's ids and an end id, cut into full sequences and a rest: ``start, length, ids_crc32, doc_tokens``.

    A null or empty text is the end id alone. Repeated rows give repeated pieces.
    """

    def start():
        bpe = library_bpe(path)
        end = bpe._packed([end_id])

        def each(batch: pa.RecordBatch):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(bpe.encode(text or "") + end)
                total = len(ids) // 4
                for at in range(0, total, sequence):
                    piece = ids[4 * at : 4 * (at + sequence)]
                    yield row, at, len(piece) // 4, zlib.crc32(piece), total

        return each

    kind = df.schema[id_column].dataType.simpleString()
    return map_batches(
        df,
        [df[id_column], df[text_column]],
        f"`{id_column}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint",
        start,
    )


@dataclass(frozen=True)
class Pattern:
    """So many sequences, each with these (size, pieces)."""

    sizes: tuple[tuple[int, int], ...]
    sequences: int


def size_of(length: Column, sequence: int, unit: int = UNIT) -> Column:
    """The size a piece is planned with: steps of 1 below ``EXACT``, of 2 below twice that, and so on up to ``unit``."""
    size, step, below = F.ceil(length / unit) * unit, unit // 2, EXACT * unit // 2
    while step:
        size = F.when(length < below, F.ceil(length / step) * step).otherwise(size)
        step, below = step // 2, below // 2
    return F.least(size, F.lit(sequence)).cast("long")


def cutting_patterns(demand: dict[int, int], capacity: int, unit: int = UNIT) -> list[Pattern]:
    """Patterns that together have a place for every demanded piece: the linear program rounded down, then the rest
    first fit by falling size. Whatever fits in units fits exactly, so columns come from the shorter knapsack first."""
    sizes = np.array(sorted(size for size, count in demand.items() if count), dtype=np.int64)
    if not len(sizes):
        return []
    wanted = np.array([demand[size] for size in sizes], dtype=np.float64)
    columns = np.diag((capacity // sizes).astype(np.float64))
    inverse, level = np.diag(1.0 / np.diag(columns)), wanted / np.diag(columns)
    cost = np.ones(len(sizes))
    rounded, coarse = -(-sizes // unit), capacity // unit > 1
    needed = float("inf")
    for pivot in range(1, MOST_PIVOTS):
        if pivot % REFRESHED == 0:
            inverse = np.linalg.inv(columns)
            level = np.maximum(inverse @ wanted, 0.0)
            if cost @ level > (1 - STALLED) * needed:
                break
            needed = cost @ level
        prices = cost @ inverse
        worst = int(prices.argmin())
        if prices[worst] < -1e-9:
            entering, price = np.zeros(len(sizes)), 0.0
            entering[worst] = -1.0
        else:
            price = 1.0
            if coarse:
                entering = knapsack(rounded, prices, capacity // unit)
                coarse = prices @ entering > 1 + GAIN
            if not coarse:
                entering = knapsack(sizes, prices, capacity)
                if prices @ entering <= 1 + GAIN:
                    break
        change = inverse @ entering
        ratios = np.full(len(sizes), np.inf)
        np.divide(level, change, out=ratios, where=change > 1e-9)
        leaving = int(ratios.argmin())
        if not np.isfinite(ratios[leaving]):
            break
        step = ratios[leaving]
        level = level - step * change
        level[leaving] = step
        row = inverse[leaving] / change[leaving]
        inverse -= np.outer(change, row)
        inverse[leaving] = row
        columns[:, leaving], cost[leaving] = entering, price
    patterns = []
    left = wanted.astype(np.int64)
    for column, count, price in zip(columns.T.round().astype(np.int64), level, cost, strict=True):
        count = int(np.floor(count + 1e-6))
        if count > 0 and price:
            patterns.append(Pattern(tuple((int(s), int(n)) for s, n in zip(sizes, column, strict=True) if n), count))
            left -= column * count
    return patterns + first_fit({int(s): int(n) for s, n in zip(sizes, left, strict=True) if n > 0}, capacity)


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """The pattern of greatest price within the capacity, any number of each size; of equal sizes the dearest counts.

    One size after another, copies by doubling: 1 more, then 2, 4 and so on.
    """
    best = np.zeros(capacity + 1)
    order = np.lexsort((-prices, sizes))
    dearest = order[np.append(True, np.diff(sizes[order]) > 0)]
    dearest = dearest[(prices[dearest] > 0) & (sizes[dearest] <= capacity)]
    for size, price in zip(sizes[dearest].tolist(), prices[dearest].tolist(), strict=True):
        while size <= capacity:
            np.maximum(best[size:], best[:-size] + price, out=best[size:])
            size, price = 2 * size, 2 * price
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        fitting = dearest[sizes[dearest] <= room]
        values = best[room - sizes[fitting]] + prices[fitting]
        top = int(values.argmax()) if len(values) else -1
        if top < 0 or values[top] <= best[room - 1] + 1e-12:
            room -= 1
        else:
            pattern[fitting[top]] += 1
            room -= int(sizes[fitting[top]])
    return pattern


def first_fit(demand: dict[int, int], capacity: int) -> list[Pattern]:
    """One pattern per sequence: fill each with the largest sizes that still fit."""
    left, patterns = dict(sorted(demand.items(), reverse=True)), []
    while left:
        room, taken = capacity, []
        for size in list(left):
            if number := min(left[size], room // size):
                taken.append((size, number))
                room -= size * number
                left[size] -= number
                if not left[size]:
                    del left[size]
        alike = min([left.get(size, 0) // number for size, number in taken])
        for size, number in taken:
            if alike:
                left[size] -= alike * number
                if not left[size]:
                    del left[size]
        patterns.append(Pattern(tuple(taken), 1 + alike))
    return patterns


def places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By size, the runs of places: first rank, pieces per sequence, first sequence, place within the sequence."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ends: dict[int, int] = {}
    first = 0
    for pattern in patterns:
        place = 0
        for size, number in pattern.sizes:
            begin = ends.get(size, 0)
            runs.setdefault(size, []).append((begin, number, first, place))
            ends[size] = begin + number * pattern.sequences
            place += number
        first += pattern.sequences
    return {size: np.array(rows, dtype=np.int64) for size, rows in runs.items()}


def pack(pieces: DataFrame, id_column: str = "doc_id", sequence: int = SEQUENCE, unit: int = UNIT) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: no sequence is longer than ``sequence``, offsets have no gaps.

    ``pieces`` has the columns of ``token_pieces`` and must be cheap to read twice. Pieces of one length are ranked
    over hashed buckets, so a frequent length needs no task of its own size; a sequence has at most ``sequence``
    pieces.
    """
    find_package_in_workers(pieces.sparkSession)
    sized = pieces.withColumn("size", size_of(F.col("length"), sequence, unit))
    demand = {row["size"]: row["count"] for row in sized.groupBy("size").count().collect()}
    runs = places(cutting_patterns(demand, sequence, unit))
    ranked = with_rank(sized, ["size"], [id_column, "start", "length", "ids_crc32"], "rank")

    def assign(frames):
        for frame in frames:
            sequences, at = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            ranks, sizes = frame["rank"].to_numpy(), frame["size"].to_numpy()
            for size in np.unique(sizes):
                mine = sizes == size
                table = runs[int(size)]
                run = table[np.searchsorted(table[:, 0], ranks[mine], side="right") - 1]
                within = ranks[mine] - run[:, 0]
                sequences[mine], at[mine] = run[:, 2] + within // run[:, 1], run[:, 3] + within % run[:, 1]
            yield pd.concat([frame.drop(columns=["rank", "size"]), pd.DataFrame({"sequence_id": sequences, "place": at}, index=frame.index)], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    assigned = ranked.mapInPandas(assign, f"{schema}, sequence_id bigint, place bigint")
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))
    return assigned.withColumn("offset", offset).drop("place")


def pack_documents(documents: DataFrame) -> DataFrame:
    return pack(stored(token_pieces(documents)))


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
