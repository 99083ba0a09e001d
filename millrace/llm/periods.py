"""Operator 12: periodic runs of words by internal pattern matching.

A run is a stretch of words that repeats with its smallest period at least ``exponent`` times and that no neighbouring
word extends. Blocks of 8, 16, 32 ... words at multiples of their length are asked where they occur next: a run of
period q has a block of the greatest such length up to q (8 at least) that occurs again q words later. All occurrences
of a block are neighbours in the suffix array, and the next one from a place on is a range successor: the least value
not below that place in a range of the array, found by a wavelet tree. Occurrences that overlap by half a block or more
go on as a progression, whose difference is a period; the stretch with that period is skipped as a whole, and where two
such stretches end alike tells how far apart they are. Every candidate is extended in both directions.

Suffixes are sorted by doubling, each text by itself; the ranks of each step answer how long two places agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.batches import map_batches
from millrace.llm.registry import query

SHORTEST = 24
EXPONENT = 3
#: Words of the shortest block; with blocks this long and twice this, runs of ``SHORTEST`` words are found.
BLOCK = 8
#: Words of several texts that are looked at together; a longer text is looked at alone.
WORDS_AT_A_TIME = 1 << 19


class Ranks:
    """For each power of two, which places of a text have the same words ahead, as the place of the first of them in
    the suffix array; places of different texts never do, nor do places nearer to the end than the words."""

    def __init__(self, ids: np.ndarray, text: np.ndarray):
        """``ids`` number the words from 0 so that no two texts share one and those of later texts are larger."""
        n = len(ids)
        self.n, self.text = n, text
        counts = np.bincount(ids)
        ranks = (np.cumsum(counts) - counts)[ids]
        self.levels = [np.append(ranks, -1).astype(np.int32)]
        open_places = np.flatnonzero(counts[ids] > 1)
        length = 1
        while len(open_places):
            ranks, open_places = self._doubled(ranks, open_places, length)
            self.levels.append(np.append(ranks, -1).astype(np.int32))
            length *= 2
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[ranks] = np.arange(n)

    def _doubled(self, ranks: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks by twice the length, and the places that still share theirs."""
        ahead = places + length
        inside = ahead < self.n
        inside[inside] = self.text[ahead[inside]] == self.text[places[inside]]
        second = np.zeros(len(places), np.int64)
        second[inside] = ranks[ahead[inside]] + 1
        keys = ranks[places] * np.int64(self.n + 1) + second
        order = np.argsort(keys)
        keys, places = keys[order], places[order]
        old = ranks[places]
        new_class, new_part = np.append(True, old[1:] != old[:-1]), np.append(True, keys[1:] != keys[:-1])
        at = np.arange(len(places))
        class_start = np.maximum.accumulate(np.where(new_class, at, 0))
        part_start = np.maximum.accumulate(np.where(new_part, at, 0))
        ranks = ranks.copy()
        ranks[places] = old + part_start - class_start
        alone = new_part & np.append(new_part[1:], True)
        return ranks, places[~alone]

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from places ``a`` and ``b`` on agree; a < b."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            same = self.levels[k][a] == self.levels[k][b]
            a[same] += 1 << k
            b[same] += 1 << k
        return a - start

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before places ``a`` and ``b`` agree; a < b."""
        a, b = a.copy(), b.copy()
        start = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            far, step = a >= 1 << k, 1 << k
            same = far & (self.levels[k][np.where(far, a - step, 0)] == self.levels[k][np.where(far, b - step, self.n)])
            a[same] -= step
            b[same] -= step
        return start - a


class WaveletTree:
    """Values in a fixed order, asked for the least one from a bound on in a range of that order."""

    def __init__(self, values: np.ndarray, limit: int):
        self.limit = limit
        self.bits = range(max(1, int(limit).bit_length()) - 1, -1, -1)
        self.before, self.zeros = [], []
        for bit in self.bits:
            zero = (values >> bit & 1) == 0
            self.before.append(np.concatenate([[0], np.cumsum(zero)]))
            self.zeros.append(int(self.before[-1][-1]))
            values = np.concatenate([values[zero], values[~zero]])

    def successor(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The least value of at least ``bound`` among those in [left, right); ``limit`` where there is none."""
        smaller, low, high = np.zeros(len(left), np.int64), left, right
        for bit, before, zeros in zip(self.bits, self.before, self.zeros, strict=True):
            low_zero, high_zero = before[low], before[high]
            one = (bound >> bit & 1) == 1
            smaller += np.where(one, high_zero - low_zero, 0)
            low = np.where(one, zeros + low - low_zero, low_zero)
            high = np.where(one, zeros + high - high_zero, high_zero)
        found = smaller < right - left
        rank, low, high, value = np.where(found, smaller, 0), left, right, np.zeros(len(left), np.int64)
        for bit, before, zeros in zip(self.bits, self.before, self.zeros, strict=True):
            low_zero, high_zero = before[low], before[high]
            here = high_zero - low_zero
            one = rank >= here
            rank = np.where(one, rank - here, rank)
            value |= one.astype(np.int64) << bit
            low = np.where(one, zeros + low - low_zero, low_zero)
            high = np.where(one, zeros + high - high_zero, high_zero)
        return np.where(found, value, self.limit)


def candidate_periods(ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances at which words may repeat, for all runs of ``SHORTEST`` words and three periods or more."""
    places, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n, text = ranks.n, ranks.text
    level = BLOCK.bit_length() - 1
    if level >= len(ranks.levels):
        return places[0], distances[0]
    # Only places whose next eight words come again matter; the tree holds these, in the order of the suffix array.
    sizes = np.bincount(ranks.levels[level][:n], minlength=n)
    repeated = sizes[ranks.levels[level][:n]] > 1
    by_suffix = repeated[ranks.suffixes]
    packed = np.concatenate([[0], np.cumsum(by_suffix)])
    tree = WaveletTree(ranks.suffixes[by_suffix], n)
    while level < len(ranks.levels):
        block, known = 1 << level, ranks.levels[level][:n]
        sizes = np.bincount(known, minlength=n)
        at = np.arange(0, n - block + 1, block)
        at = at[(text[at] == text[at + block - 1]) & (sizes[known[at]] > 1)]
        first = known[at].astype(np.int64)
        for found in _block_candidates(ranks, tree, at, packed[first], packed[first + sizes[first]], block):
            places.append(found[0])
            distances.append(found[1])
        level += 1
    pairs = np.unique(np.concatenate(places) * np.int64(n + 1) + np.concatenate(distances))
    return pairs // (n + 1), pairs % (n + 1)


def _block_candidates(
    ranks: Ranks, tree: WaveletTree, at: np.ndarray, left: np.ndarray, right: np.ndarray, block: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distances to further occurrences of the blocks at ``at``, less than two blocks away."""
    last, ask, live = at.copy(), at + 1, np.arange(len(at))
    while len(live):
        found = tree.successor(left[live], right[live], ask[live])
        near = found < np.minimum(at[live] + 2 * block, ranks.n)
        live, found = live[near], found[near]
        gap = found - last[live]
        yield at[live], found - at[live]
        goes_on = gap <= block // 2
        single = live[~goes_on]
        last[single], ask[single] = found[~goes_on], found[~goes_on] + 1
        progression, step = live[goes_on], gap[goes_on]
        if not len(progression):
            continue
        here, mine = last[progression], at[progression]
        end = here + step + ranks.ahead(here, here + step)
        other = here != mine
        if other.any():
            begin = here[other] - ranks.behind(here[other], here[other] + step[other])
            own, period = mine[other], step[other]
            own_end = own + period + ranks.ahead(own, own + period)
            own_begin = own - ranks.behind(own, own + period)
            yield own, begin - own_begin
            yield own, end[other] - own_end
        ask[progression] = end - block + 1
        last[progression] = here + (end - block - here) // step * step


def runs_of(ids: np.ndarray, text: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT) -> np.ndarray:
    """Start, length and period of all runs, as rows sorted by start and period."""
    if not len(ids):
        return np.zeros((0, 3), np.int64)
    ranks = Ranks(ids, text)
    place, period = candidate_periods(ranks)
    other = place + period
    inside = (period > 0) & (other < ranks.n)
    place, period, other = place[inside], period[inside], other[inside]
    alike = text[place] == text[other]
    place, period, other = place[alike], period[alike], other[alike]
    start = place - ranks.behind(place, other)
    end = other + ranks.ahead(place, other)
    long = end - start >= np.maximum(shortest, exponent * period)
    start, end, period = start[long], end[long], period[long]
    # A stretch found with a multiple of its period is found with the period as well.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    smallest = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[: len(start)]
    found = np.stack([start, end - start, period], axis=1)[smallest]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of_texts(texts: list[list[bytes]], shortest: int = SHORTEST, exponent: int = EXPONENT) -> list[np.ndarray]:
    """The runs of each text, given as words; a bounded number of words is looked at together."""
    results: list[np.ndarray] = []
    held: list[list[bytes]] = []
    size = 0

    def finished() -> Iterator[np.ndarray]:
        lengths = np.array([len(words) for words in held], np.int64)
        ids, first = np.empty(int(lengths.sum()), np.int64), 0
        at = 0
        for words in held:
            number: dict[bytes, int] = {}
            ids[at : at + len(words)] = [number.setdefault(word, len(number)) for word in words]
            ids[at : at + len(words)] += first
            first, at = first + len(number), at + len(words)
        text = np.repeat(np.arange(len(held)), lengths)
        found = runs_of(ids, text, shortest, exponent)
        begins = np.cumsum(lengths) - lengths
        of = text[found[:, 0]] if len(found) else np.zeros(0, np.int64)
        borders = np.searchsorted(of, np.arange(len(held) + 1))
        for k, begin in enumerate(begins):
            yield found[borders[k] : borders[k + 1]] - [begin, 0, 0]

    for words in texts:
        if held and size + len(words) > WORDS_AT_A_TIME:
            results.extend(finished())
            held, size = [], 0
        held.append(words)
        size += len(words)
    results.extend(finished())
    return results


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that are in no run after its first period, joined by a space."""
    if not len(runs):
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(steps)[:-1] == 0).tolist()])


def periodic_runs(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = SHORTEST, exponent: int = EXPONENT
) -> DataFrame:
    """One row per row of ``df``: its id, ``n_words``, ``runs`` (start, length, period in words, by start, then period)
    and ``collapsed``, the text without the repetitions, its words joined by one space.

    Words are stretches without ASCII white space. A null or empty text has no words, no runs and an empty ``collapsed``.
    Repeated rows give equal rows; other columns are not looked at, whatever they are called. ``shortest`` is 24 or
    more and ``exponent`` 3 or more, as shorter runs need shorter blocks.
    """
    if shortest < SHORTEST or exponent < EXPONENT:
        raise ValueError(f"runs of at least {SHORTEST} words and {EXPONENT} periods can be found")

    def start():
        def each(batch: pa.RecordBatch):
            ids, texts = batch.column(0).to_pylist(), [(text or b"").split() for text in batch.column(1).to_pylist()]
            for row, words, runs in zip(ids, texts, runs_of_texts(texts, shortest, exponent), strict=True):
                spans = [{"start": a, "length": b, "period": c} for a, b, c in runs.tolist()]
                yield row, len(words), spans, collapsed(words, runs)

        return each

    kind = df.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary"
    found = map_batches(df, [df[id_column], df[text_column].cast("binary")], schema, start)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def with_periodic_tails(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and text of each row; every tenth text, by a checksum of its id, repeats some of its words from a place on."""

    def start():
        def each(batch: pa.RecordBatch):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield row, planted(row, text)

        return each

    kind = df.schema[id_column].dataType.simpleString()
    return map_batches(df, [df[id_column], df[text_column].cast("binary")], f"`{id_column}` {kind}, `{text_column}` binary", start)


def planted(row: int | None, text: bytes | None) -> bytes | None:
    check = zlib.crc32(str(row).encode())
    if row is None or not text or check % 10:
        return text
    words, draw = text.split(), check // 10
    n = len(words)
    if not n:
        return text
    begin = draw % n
    period = 1 + (n - begin) // (3 + draw % 8)
    tail = words[begin : begin + period] * (1 + (n - begin) // period)
    return b" ".join([*words[:begin], *tail[: n - begin]])


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, the one with the greatest exponent, and the text without repetitions, as digests."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(with_periodic_tails(documents))
    best = F.aggregate(
        "runs",
        F.get("runs", F.lit(0)),
        lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best),
    )
    line = lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
