"""Operator 11: benchmark decontamination by winnowing.

A window is so many consecutive words of an item; an item with fewer words is one window as a whole. For windows of n
words the k-grams are half as long, and of every n - k + 1 neighbouring k-grams the least hash is kept, so that a text
which has a window's words keeps the fingerprint of that window too, at the same word. Fingerprints of the benchmark
go into a bitmap of bounded size, built by Spark; documents keep what meets it. Each hit is extended to the windows
around it, and those are joined to the windows of the items by their words, so nothing rests on a hash alone.

Windows know the set of items they occur in by one name, and documents with the same sets share one list of items, so
a passage that many documents and many items have is not multiplied out.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.folders import stored
from millrace.llm.batches import map_batches
from millrace.llm.registry import query
from millrace.operators.broadcasts import join_lookup

WINDOW = 10
#: Bits per window of the benchmark, and the least and most bits of the bitmap, as powers of two; it is broadcast.
BITS_PER_WINDOW = 64
LEAST_BITS, MOST_BITS = 16, 27
#: Bits in one row of Spark's bitmaps.
_BITMAP_ROW = 1 << 15
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _word_table() -> np.ndarray:
    """For each byte its lower-case form where it belongs to a word, else 0: digits, letters and all beyond ASCII."""
    table = np.zeros(256, np.uint8)
    for byte in range(256):
        if byte >= 128 or chr(byte).isalnum():
            table[byte] = ord(chr(byte).lower()) if byte < 128 else byte
    return table


_TABLE = _word_table()


@dataclass(frozen=True)
class Words:
    """The words of several texts, one after another: their bytes, borders, text number and hash."""

    data: bytes
    begin: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hashes: np.ndarray

    def joined(self, first: int, count: int) -> bytes:
        return b" ".join(self.data[a:b] for a, b in zip(self.begin[first : first + count], self.end[first : first + count], strict=True))


def words_of(texts: list[bytes | None]) -> Words:
    """The words of texts, A-Z in lower case; a null text has none."""
    parts = [text or b"" for text in texts]
    raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    lower = _TABLE[raw]
    inside = np.concatenate([[False], lower != 0, [False]])
    borders = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = borders[::2], borders[1::2]
    limits = np.cumsum([len(part) + 1 for part in parts])
    text = np.searchsorted(limits, begin, side="right")
    return Words(lower.tobytes(), begin, end, text, word_hashes(lower, begin, end))


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(32)) * _MIX
    return values ^ values >> np.uint64(29)


def word_hashes(lower: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of each word, that depends on its bytes alone."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    lengths = end - begin
    starts = np.cumsum(lengths) - lengths
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64))
    place = np.arange(int(lengths.sum())) - np.repeat(starts, lengths)
    return mixed(np.add.reduceat(lower[lower != 0].astype(np.uint64) * powers[place], starts))


def gram_hashes(hashes: np.ndarray, first: np.ndarray | None, count: int, seed: int) -> np.ndarray:
    """Hashes of ``count`` words from each place, or from the places ``first`` alone; those at the end are left out."""
    reach = max(0, len(hashes) - count + 1)
    found = np.full(reach if first is None else len(first), seed, np.uint64)
    for k in range(count):
        found = found * _BASE + (hashes[k : k + reach] if first is None else hashes[first + k])
    return mixed(found)


def gram_words(window: int) -> int:
    """Words in a k-gram for windows of so many words."""
    return max(1, window // 2)


def fingerprints(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that are the least of some window within one text; ties are all kept."""
    size = gram_words(window)
    grams = gram_hashes(words.hashes, None, size, window)
    reach = len(words.hashes) - window + 1
    if reach <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = grams[:reach].copy()
    for k in range(1, window - size + 1):
        np.minimum(least, grams[k : k + reach], out=least)
    whole = words.text[:reach] == words.text[window - 1 :]
    kept = np.zeros(len(grams), bool)
    for k in range(window - size + 1):
        kept[k : k + reach] |= whole & (grams[k : k + reach] == least)
    places = np.flatnonzero(kept)
    return places, grams[places]


def candidate_windows(words: Words, window: int, known: Bitmap) -> np.ndarray:
    """Where windows begin that may be windows of an item: fingerprints that are known, extended to whole windows."""
    places, hashes = fingerprints(words, window)
    places = places[known.has(hashes)]
    around = (places[:, None] - np.arange(window - gram_words(window) + 1)).ravel()
    around = np.unique(around[(around >= 0) & (around + window <= len(words.hashes))])
    around = around[words.text[around] == words.text[around + window - 1]]
    return around[known.has(gram_hashes(words.hashes, around, window, window + WINDOW_SEED))]


#: Hashes of whole windows are told from those of fingerprints by their seed.
WINDOW_SEED = 1 << 20


@dataclass(frozen=True)
class Bitmap:
    """A set of hashes that may say yes too often; ``bits`` is a power of two."""

    bits: int
    held: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = positions(hashes, self.bits)
        return (self.held[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes & np.uint64(bits - 1)).astype(np.int64)


def item_windows(items: DataFrame, item_column: str = "item_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """``window`` (its words, joined by a space), ``words`` (how many) and ``item`` (its id as a string) of each item."""

    def start():
        def each(batch: pa.RecordBatch):
            ids, words = batch.column(0).to_pylist(), words_of(batch.column(1).to_pylist())
            for number, begin, end in _text_ranges(words, len(ids)):
                size = min(window, end - begin)
                for at in range(begin, end - size + 1) if size else ():
                    yield words.joined(at, size), size, ids[number]

        return each

    columns = [items[item_column].cast("string"), items[text_column].cast("binary")]
    return map_batches(items, columns, "window binary, words int, item string", start)


def window_bitmap(windows: DataFrame, rows: int) -> Bitmap:
    """Fingerprints and hashes of all windows, put together by Spark; at most 2 ** ``MOST_BITS`` bits reach the driver."""
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (BITS_PER_WINDOW * rows).bit_length()))

    def start():
        def each(batch: pa.RecordBatch):
            texts, sizes = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist())
            for size in np.unique(sizes).tolist():
                words = words_of([text for text, mine in zip(texts, sizes, strict=True) if mine == size])
                whole = gram_hashes(words.hashes, np.arange(0, len(words.hashes), size), size, size + WINDOW_SEED)
                for found in (fingerprints(words, size)[1], whole):
                    yield from zip(positions(found, bits).tolist(), strict=True)

        return each

    marks = map_batches(windows, [windows["window"], windows["words"]], "position bigint", start)
    rows_of = marks.groupBy((F.col("position") / _BITMAP_ROW).cast("long").alias("row")).agg(
        F.bitmap_construct_agg(F.col("position") % _BITMAP_ROW).alias("held")
    )
    held = np.zeros(bits // 8, np.uint8)
    for row in rows_of.collect():
        at = row["row"] * (_BITMAP_ROW // 8)
        held[at : at + _BITMAP_ROW // 8] = np.frombuffer(row["held"], np.uint8)[: len(held) - at]
    return Bitmap(bits, held)


def _text_ranges(words: Words, texts: int) -> Iterable[tuple[int, int, int]]:
    """Number, first word and end of each text."""
    ends = np.searchsorted(words.text, np.arange(texts), side="right").tolist()
    return zip(range(texts), [0, *ends[:-1]], ends, strict=True)


def _covered(hits: Column) -> Column:
    """How many words spans of (begin, words) cover together."""
    nothing = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("end"))

    def add(state: Column, hit: Column) -> Column:
        begin, end = F.greatest(state["end"], hit["begin"]), hit["begin"] + hit["words"]
        return F.struct(
            (state["covered"] + F.greatest(F.lit(0).cast("long"), end - begin)).alias("covered"), F.greatest(state["end"], end).alias("end")
        )

    return F.aggregate(F.array_sort(hits), nothing, add, lambda state: state["covered"])


def find_contamination(
    documents: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """One row per row of ``documents``: its id, ``n_words``, ``n_hit`` (words within a window that an item has too),
    ``items`` (ids of the items with such windows, as sorted strings) and ``hits`` (spans of first word and words).

    Null and empty texts have no words and no hits; an item without words has no window. Items without an id hit words,
    but are not among ``items``; of items with one id all windows count. Repeated rows are told apart by number alone.
    Other columns are not looked at, whatever they are called. Empty tables on either side give no hits.
    """
    found = item_windows(items, item_column, item_text_column, window)
    by_window = found.groupBy("window", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    windows = stored(by_window.withColumn("set", F.sha2(F.to_json("items"), 256)))
    rows = windows.count()
    sizes = sorted(row["words"] for row in windows.select("words").distinct().collect())
    known = window_bitmap(windows, rows)
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def start():
        def each(batch: pa.RecordBatch):
            ids, digests, texts = (column.to_pylist() for column in batch.columns)
            words = words_of(texts)
            hits: dict[int, list[dict]] = {}
            for size in sizes:
                for at in candidate_windows(words, size, shared.value).tolist():
                    hits.setdefault(int(words.text[at]), []).append({"at": at, "words": size, "window": words.joined(at, size)})
            for number, begin, end in _text_ranges(words, len(ids)):
                mine = [hit | {"at": hit["at"] - begin} for hit in hits.get(number, [])]
                yield ids[number], digests[number], end - begin, mine

        return each

    kind = documents.schema[id_column].dataType.simpleString()
    columns = [documents[id_column].alias("id"), F.xxhash64(documents[text_column]), documents[text_column].cast("binary")]
    schema = f"id {kind}, digest bigint, n_words bigint, candidates array<struct<at: bigint, words: int, window: binary>>"
    read = map_batches(documents, columns, schema, start)
    each_candidate = read.select("id", "digest", "n_words", F.posexplode_outer("candidates").alias("number", "candidate"))
    each_candidate = each_candidate.select("id", "digest", "n_words", "number", "candidate.at", F.col("candidate.window").alias("window"))
    matched = join_lookup(each_candidate, windows.select("window", "words", "set"), ["window"], rows=rows, limit=broadcast_rows)
    hit = F.struct(F.col("at").alias("begin"), F.col("words").cast("long").alias("words"))
    marked = stored(
        matched.groupBy("id", "digest").agg(
            F.max("n_words").alias("n_words"),
            F.sum(F.when(F.coalesce("number", F.lit(0)) == 0, 1).otherwise(0)).alias("copies"),
            F.collect_set(F.when(F.col("set").isNotNull(), hit)).alias("hits"),
            F.array_sort(F.collect_set("set")).alias("sets"),
        )
    )
    lists = windows.groupBy("set").agg(F.first("items").alias("of_set"))
    hit_rows, others = marked.where(F.size("sets") > 0), marked.where(F.size("sets") == 0)
    named = stored(
        hit_rows.select("sets")
        .distinct()
        .select("sets", F.explode("sets").alias("set"))
        .join(lists, "set")
        .select("sets", F.explode("of_set").alias("item"))
        .groupBy("sets")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    # Many documents may have the same sets: their lists are broadcast as long as all of them together are small.
    listed = named.agg(F.sum(F.size("items") + 1).alias("listed")).first()["listed"] or 0
    with_items = join_lookup(hit_rows, named, ["sets"], rows=listed, limit=broadcast_rows)
    every = with_items.unionByName(others, allowMissingColumns=True)
    result = every.withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    return result.select(
        F.col("id").alias(id_column),
        "n_words",
        _covered(F.col("hits")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.array_sort("hits").alias("hits"),
    )


#: Windows of ten words; both sides are split into words by their bytes, A-Z in lower case.
ORACLE = r"""
    with d as (
        select doc_id, n, w from (select row_number() over () n, doc_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents)),
    i as (
        select item_id, w, least(len(w), 10) size from (select item_id, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark)),
    iw as (
        select distinct item_id, size, w[a : a + size - 1] win
        from (select item_id, w, size, unnest(range(1, len(w) - size + 2)) a from i where size > 0)),
    sizes as (select distinct size from iw),
    dw as (
        select n, a, size, w[a : a + size - 1] win
        from (select n, w, size, unnest(range(1, len(w) - size + 2)) a from d, sizes where len(w) >= size)),
    m as (select dw.n, dw.a, dw.size, iw.item_id from dw join iw on dw.size = iw.size and dw.win = iw.win),
    hit as (select n, count(distinct p) n_hit from (select n, unnest(range(a, a + size)) p from m) group by n),
    its as (select n, list_sort(list(distinct cast(item_id as varchar))) items from m where item_id is not null group by n)
    select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
        cast(coalesce(len(items), 0) as bigint) as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256,
        coalesce(n_hit, 0) > 0 as contaminated
    from d left join hit using (n) left join its using (n)"""


@query("op11_benchmark_decontamination", ORACLE)
def op11_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents have ten words in a row, or all words, of a benchmark item, and of which items."""
    documents, items = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    found = find_contamination(documents, items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
