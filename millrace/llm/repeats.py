"""Operator 1: removal of repeated passages by prefix-free parsing and truncated suffix arrays.

A window of ``length`` bytes is a repeat if an equal one starts earlier: in a document with a smaller id, or before
it in the same document. Every byte a repeat covers is removed.

Texts are parsed into phrases (``phrases``). The parse is looked at first, as keys and digests only:

1. Phrases whose key occurs once in the corpus have no repeats.
2. Of phrases with one key, those whose context (all bytes of their windows) was seen earlier are repeats as a whole.
3. What is left, the first occurrences of several contexts with one key, is the dictionary: these contexts meet in one task per key,
   their suffixes are sorted as far as ``length`` bytes, and of equal ones all but the earliest are repeats.

Between the steps only keys, digests and places move, packed into parcels of arrays. The texts are dealt once over
blocks and kept as a bucketed table in the shared folder; a later step is a co-group of blocks and parcels, which
moves the parcels alone. Keys that occur more often than ``hot`` times would bring too much to one task: their
windows go on one by one, dealt by their own digests. Within a block (and, for keys, a task) copies are thinned out first.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from millrace.functions.folders import new_folder, stored
from millrace.llm.batches import find_package_in_workers, shuffle_partitions
from millrace.llm.phrases import parse
from millrace.llm.registry import query

LENGTH = 100
GRAM = 36
HOT = 10_000
#: Hot keys reach the driver; more than so many cannot be, as each stands for this share of all phrases.
MOST_HOT = 1_000_000
PHRASE_BYTES = 30
LEAST_ID = -(1 << 63)
COPY_BITS = 40
ENTRY, SPAN, HOT_KEY, PARTIAL = range(4)
PARCEL = "part int, kind int, block int, key binary, context binary, doc binary, place binary, windows binary"
PARCEL_FIELDS = pa.schema(
    [(name, pa.int32()) for name in ("part", "kind", "block")]
    + [(name, pa.binary()) for name in ("key", "context", "doc", "place", "windows")]
)
#: The dictionary of a task is sorted in so many parts, one after the other.
FINE = 8


class Parcels:
    """Rows of ``PARCEL``: arrays of phrases, packed."""

    kinds = {"key": "<u8", "context": "<u8", "doc": "<i8", "place": "<i8", "windows": "<i4"}

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, part: int, kind: int, block: int, **arrays: np.ndarray | bytes) -> None:
        packed = {
            name: array if isinstance(array, bytes) else np.ascontiguousarray(array, self.kinds[name]).tobytes()
            for name, array in arrays.items()
        }
        self.rows.append((int(part), kind, int(block), *(packed.get(name) for name in self.kinds)))

    def deal(self, parts: np.ndarray, kind: int, block: int, **arrays: np.ndarray) -> None:
        """One parcel per part."""
        order = np.argsort(parts, kind="stable")
        for begin, end in runs(parts[order]):
            chosen = order[begin:end]
            self.add(parts[chosen[0]], kind, block, **{name: array[chosen] for name, array in arrays.items()})

    def table(self) -> pa.Table:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in PARCEL_FIELDS]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PARCEL_FIELDS, strict=True)], schema=PARCEL_FIELDS)

    def batches(self) -> list[pa.RecordBatch]:
        return self.table().to_batches(max_chunksize=256)


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal neighbours."""
    if len(values):
        borders = np.flatnonzero(values[1:] != values[:-1]) + 1
        yield from zip([0, *borders.tolist()], [*borders.tolist(), len(values)], strict=True)


def unpacked(column: list[bytes | None], kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(value or b"" for value in column), kind)


def first_of_each(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For rows in ``order``, whether each differs from the one before in some key."""
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    return new


def _by_part(parcels: DataFrame, parts: int, finish: Callable[[dict], Parcels]) -> DataFrame:
    """Parcels dealt by ``part``; each task gathers its parcels and hands them on at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: dict[str, list] = {name: [] for name in PARCEL_FIELDS.names}
        for batch in batches:
            for name, held in columns.items():
                held.extend(batch.column(batch.schema.get_field_index(name)).to_pylist())
        if columns["part"]:
            yield from finish(columns).batches()

    return parcels.repartitionById(parts, F.col("part") % parts).mapInArrow(run, PARCEL)


def _with_blocks(blocks: DataFrame, parcels: DataFrame, each: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    return blocks.groupBy("block").cogroup(parcels.groupBy("block")).applyInArrow(each, schema)


def blocks_of(df: DataFrame, id_column: str, text_column: str, carried: list[str]) -> tuple[DataFrame, int]:
    """Texts dealt over blocks as a bucketed table, ``block, doc, copy, text, other_0 ..``, and their bytes.

    ``copy`` tells rows with one id apart. The table goes when the application ends.
    """
    spark, parts = df.sparkSession, shuffle_partitions(df.sparkSession)
    others = [F.col(name).alias(f"other_{k}") for k, name in enumerate([id_column, *carried])]
    rows = df.select(
        F.coalesce(F.col(id_column).cast("long"), F.lit(LEAST_ID)).alias("doc"),
        F.coalesce(F.col(text_column), F.lit("")).cast("binary").alias("text"),
        *others,
    ).withColumn("block", F.pmod(F.xxhash64("doc"), F.lit(2 * parts)).cast("int"))
    copy = F.row_number().over(Window.partitionBy("block", "doc").orderBy(F.xxhash64("text"), F.crc32("text"))) - 1
    measured = Observation()
    dealt = rows.repartition(parts, "block").withColumn("copy", copy).observe(measured, F.sum(F.octet_length("text")).alias("bytes"))
    name = f"millrace_blocks_{uuid.uuid4().hex}"
    writer = dealt.write.bucketBy(parts, "block").option("path", new_folder(spark, "blocks")).option("compression", "zstd")
    writer.saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name), measured.get["bytes"] or 0


def _forget(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"drop table if exists {name}")


def repeated_keys(blocks: DataFrame, parts: int, length: int, gram: int, hot: int) -> DataFrame:
    """Parcels of keys that occur more than once, for each block that has them; and the hot keys among them.

    A task sends each key once, with its count and one block; of keys it has seen twice it tells its own blocks itself.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_blocks = [], []
        for batch in batches:
            phrases = parse((text.as_py() for text in batch.column(1)), length, gram)
            held_keys.append(phrases.key)
            held_blocks.append(batch.column(0).to_numpy(zero_copy_only=False)[phrases.text])
        if not held_keys:
            return
        keys, of_block = np.concatenate(held_keys), np.concatenate(held_blocks)
        order = np.lexsort((of_block, keys))
        keys, of_block = keys[order], of_block[order]
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        times = np.diff(np.append(begins, len(keys)))
        parcels = Parcels()
        distinct = keys[begins]
        told = np.where(times > 1, -1, of_block[begins])
        parcels.deal((distinct % np.uint64(parts)).astype(np.int64), ENTRY, -1, key=distinct, doc=told, windows=times)
        often = np.repeat(times > 1, times)
        mine, mine_block = keys[often], of_block[often]
        new = np.append(True, (mine[1:] != mine[:-1]) | (mine_block[1:] != mine_block[:-1])) if len(mine) else np.zeros(0, bool)
        mine, mine_block = mine[new], mine_block[new]
        order = np.argsort(mine_block, kind="stable")
        for begin, end in runs(mine_block[order]):
            block = int(mine_block[order[begin]])
            parcels.add(block, SPAN, block, key=mine[order[begin:end]])
        yield from parcels.batches()

    def gather(columns: dict) -> Parcels:
        parcels = Parcels()
        entries = [k for k, kind in enumerate(columns["kind"]) if kind == ENTRY]
        for k, kind in enumerate(columns["kind"]):
            if kind == SPAN:
                parcels.add(0, SPAN, columns["block"][k], key=columns["key"][k])
        keys = unpacked([columns["key"][k] for k in entries], "<u8")
        told = unpacked([columns["doc"][k] for k in entries], "<i8")
        times = unpacked([columns["windows"][k] for k in entries], "<i4").astype(np.int64)
        order = np.argsort(keys, kind="stable")
        keys, told, times = keys[order], told[order], times[order]
        if not len(keys):
            return parcels
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        totals = np.add.reduceat(times, begins)
        every = np.repeat(totals, np.diff(np.append(begins, len(keys))))
        asks = (every > 1) & (told >= 0)
        mine, mine_block = keys[asks], told[asks]
        order = np.argsort(mine_block, kind="stable")
        for begin, end in runs(mine_block[order]):
            parcels.add(0, SPAN, int(mine_block[order[begin]]), key=mine[order[begin:end]])
        if (totals > hot).any():
            parcels.add(0, HOT_KEY, -1, key=keys[begins][totals > hot])
        return parcels

    return _by_part(blocks.select("block", "text").mapInArrow(count, PARCEL), parts, gather)


def context_digests(blocks: DataFrame, repeated: DataFrame, hot_keys: np.ndarray, parts: int, length: int, gram: int) -> DataFrame:
    """Parcels of whole phrases that repeat an earlier one (``SPAN``), and of first ones of keys with several contexts (``PARTIAL``)."""

    def describe(texts: pa.Table, known: pa.Table) -> pa.Table:
        parcels = Parcels()
        if not texts.num_rows or not known.num_rows:
            return parcels.table()
        contents = texts.column("text").to_pylist()
        docs = texts.column("doc").to_numpy()
        copies = texts.column("copy").to_numpy().astype(np.int64) << COPY_BITS
        block = int(texts.column("block")[0].as_py())
        phrases = parse(contents, length, gram)
        wanted = np.flatnonzero(np.isin(phrases.key, unpacked(known.column("key").to_pylist(), "<u8")))
        text, first, windows, key = (a[wanted] for a in (phrases.text, phrases.first, phrases.windows, phrases.key))
        if len(hot_keys):
            split = np.isin(key, hot_keys)
            times = np.where(split, windows, 1)
            within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            text, first, key = np.repeat(text, times), np.repeat(first, times) + within, np.repeat(key, times)
            alone = np.repeat(split, times)
            windows = np.where(alone, 1, np.repeat(windows, times))
        digest = xxhash.xxh3_64_intdigest
        places = zip(text.tolist(), first.tolist(), (first + windows + length - 1).tolist(), strict=True)
        context = np.array([digest(contents[t][begin:end]) for t, begin, end in places], np.uint64)
        if len(hot_keys):
            key = np.where(alone, context, key)
        doc, place = docs[text], first + copies[text]
        order = np.lexsort((place, doc, context, key))
        new = first_of_each(order, key, context)
        again, sent = order[~new], order[new]
        if len(again):
            parcels.add(block, SPAN, block, doc=doc[again], place=place[again], windows=windows[again])
        parcels.deal(
            (key[sent] % np.uint64(parts)).astype(np.int64), ENTRY, block,
            key=key[sent], context=context[sent], doc=doc[sent], place=place[sent], windows=windows[sent],
        )
        return parcels.table()

    def gather(columns: dict) -> Parcels:
        parcels = Parcels()
        entries = [k for k, kind in enumerate(columns["kind"]) if kind == ENTRY]
        for k, kind in enumerate(columns["kind"]):
            if kind == SPAN:
                parcels.add(0, SPAN, columns["block"][k], **{name: columns[name][k] for name in ("doc", "place", "windows")})
        key, context, doc, place, windows = (
            unpacked([columns[name][k] for k in entries], kind) for name, kind in Parcels.kinds.items()
        )
        block = np.repeat([columns["block"][k] for k in entries], [len(columns["key"][k]) // 8 for k in entries])
        order = np.lexsort((place, doc, context, key))
        new = first_of_each(order, key, context)
        again, firsts = order[~new], order[new]
        several = np.zeros(len(firsts), bool)
        same = key[firsts[1:]] == key[firsts[:-1]]
        several[1:] |= same
        several[:-1] |= same
        partial = firsts[several]
        for chosen, kind in ((again, SPAN), (partial, PARTIAL)):
            chosen = chosen[np.argsort(block[chosen], kind="stable")]
            for begin, end in runs(block[chosen]):
                mine = chosen[begin:end]
                keys = {"key": key[mine]} if kind == PARTIAL else {}
                parcels.add(0, kind, block[mine[0]], doc=doc[mine], place=place[mine], windows=windows[mine], **keys)
        return parcels

    return _by_part(_with_blocks(blocks, repeated, describe, PARCEL), parts, gather)


def equal_suffixes(blocks: DataFrame, partial: DataFrame, parts: int, length: int) -> DataFrame:
    """Parcels of windows that repeat an earlier one, found in the sorted suffixes of the dictionary."""

    def cut(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        parcels = Parcels()
        if not texts.num_rows or not wanted.num_rows:
            return parcels.table()
        contents = texts.column("text").to_pylist()
        block = int(texts.column("block")[0].as_py())
        number = {pair: k for k, pair in enumerate(zip(texts.column("doc").to_pylist(), texts.column("copy").to_pylist(), strict=True))}
        key, doc, place, windows = (unpacked(wanted.column(name).to_pylist(), Parcels.kinds[name]) for name in ("key", "doc", "place", "windows"))
        part = (key % np.uint64(parts * FINE)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        for begin, end in runs(part[order]):
            mine = order[begin:end]
            places = zip(doc[mine].tolist(), (place[mine] >> COPY_BITS).tolist(), (place[mine] & (1 << COPY_BITS) - 1).tolist(), windows[mine].tolist(), strict=True)
            held = [contents[number[d, copy]][first : first + size + length - 1] for d, copy, first, size in places]
            parcels.add(part[mine[0]], ENTRY, block, doc=doc[mine], place=place[mine], windows=windows[mine], context=b"".join(held))
        return parcels.table()

    def gather(columns: dict) -> Parcels:
        parcels = Parcels()
        by_part: dict[int, list[int]] = {}
        for k, part in enumerate(columns["part"]):
            by_part.setdefault(part, []).append(k)
        for chosen in by_part.values():
            doc, place, windows = (unpacked([columns[name][k] for k in chosen], Parcels.kinds[name]) for name in ("doc", "place", "windows"))
            block = np.repeat([columns["block"][k] for k in chosen], [len(columns["doc"][k]) // 8 for k in chosen])
            phrase, within = repeated_windows(b"".join(columns["context"][k] for k in chosen), doc, place, windows.astype(np.int64), length)
            at = place[phrase] + within
            order = np.lexsort((at, doc[phrase], block[phrase]))
            for begin, end in runs(block[phrase][order]):
                mine = order[begin:end]
                parcels.add(0, SPAN, block[phrase[mine[0]]], **joined(doc[phrase[mine]], at[mine]))
        return parcels

    return _by_part(_with_blocks(blocks, partial, cut, PARCEL), parts, gather)


def repeated_windows(contexts: bytes, doc: np.ndarray, place: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases and offsets of the windows that equal one of an earlier place, from the contexts put together.

    The suffixes of the contexts are sorted up to ``length`` bytes; equal ones lie together, the earliest first.
    """
    data = np.frombuffer(contexts, np.uint8)
    sizes = windows + length - 1
    phrase = np.repeat(np.arange(len(windows)), windows)
    within = np.arange(len(phrase)) - np.repeat(np.cumsum(windows) - windows, windows)
    begin = np.repeat(np.cumsum(sizes) - sizes, windows) + within
    corpus = np.lexsort((place[phrase] + within, doc[phrase]))
    phrase, within, begin = phrase[corpus], within[corpus], begin[corpus]
    if not len(begin):
        return phrase, within
    suffixes = np.lib.stride_tricks.sliding_window_view(data, length)[begin]
    order = np.argsort(suffixes.view(f"S{length}").ravel(), kind="stable")
    same = (suffixes[order[1:]] == suffixes[order[:-1]]).all(axis=1)
    again = order[1:][same]
    return phrase[again], within[again]


def joined(doc: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted single windows as spans of neighbours."""
    begins = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)))
    return {"doc": doc[begins], "place": place[begins], "windows": np.diff(np.append(begins, len(doc)))}


def covered(first: np.ndarray, windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """The bytes that spans of windows cover, as maximal runs."""
    order = np.argsort(first, kind="stable")
    begin, end = first[order], (first + windows + length - 1)[order]
    if not len(begin):
        return []
    reach = np.maximum.accumulate(end)
    new = np.append(True, begin[1:] > reach[:-1])
    starts = np.flatnonzero(new)
    return list(zip(begin[starts].tolist(), reach[np.append(starts[1:], len(begin)) - 1].tolist(), strict=True))


def without_repeats(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    carried: list[str] | None = None,
    length: int = LENGTH,
    gram: int = GRAM,
    hot: int = HOT,
    kept_text: bool = False,
) -> DataFrame:
    """One row per row of ``df``: its id, ``n_bytes``, ``removed`` (spans of bytes, end exclusive) and ``kept`` (the
    other bytes; with ``kept_text`` as a text, without the letters that were cut), with the ``carried`` columns.

    Ids are integers; a null id is smaller than any. Rows with one id are told apart and come in the order of a hash of
    their texts. A null text is empty; texts shorter than ``length`` lose nothing. Windows never cross texts.
    """
    carried = carried or []
    spark = df.sparkSession
    find_package_in_workers(spark)
    parts = shuffle_partitions(spark)
    blocks, total = blocks_of(df, id_column, text_column, carried)
    often = max(hot, total // (PHRASE_BYTES * MOST_HOT))
    known = stored(repeated_keys(blocks, parts, length, gram, often))
    hot_keys = unpacked([bytes(row["key"]) for row in known.where(F.col("kind") == HOT_KEY).select("key").collect()], "<u8")
    found = stored(context_digests(blocks, known.where(F.col("kind") == SPAN), np.sort(hot_keys), parts, length, gram))
    suffixes = equal_suffixes(blocks, found.where(F.col("kind") == PARTIAL), parts, length)
    spans = found.where(F.col("kind") == SPAN).union(suffixes).select("block", "doc", "place", "windows")
    names = [id_column, *carried]
    kinds = "".join(f", `{name}` {df.schema[name].dataType.simpleString()}" for name in names)
    schema = f"n_bytes bigint, removed array<struct<begin: bigint, end: bigint>>, kept {'string' if kept_text else 'binary'}{kinds}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def cut(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        doc, place, windows = (unpacked(wanted.column(name).to_pylist(), Parcels.kinds[name]) for name in ("doc", "place", "windows"))
        order = np.lexsort((place, doc))
        doc, place, windows = doc[order], place[order], windows[order].astype(np.int64)
        copy, first = place >> COPY_BITS, place & (1 << COPY_BITS) - 1
        of = {}
        for begin, end in runs(doc):
            for low, high in runs(copy[begin:end]):
                of[int(doc[begin]), int(copy[begin + low])] = slice(begin + low, begin + high)
        rows = []
        for text, d, c in zip(*(texts.column(name).to_pylist() for name in ("text", "doc", "copy")), strict=True):
            mine = of.get((d, c))
            removed = covered(first[mine], windows[mine], length) if mine else []
            borders = [0, *(border for span in removed for border in span), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True))
            rows.append((len(text), [{"begin": a, "end": b} for a, b in removed], kept.decode("utf-8", "ignore") if kept_text else kept))
        own = [pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True) if rows else [[], [], []], arrow, strict=False)]
        others = [texts.column(f"other_{k}").cast(arrow.field(3 + k).type) for k in range(len(names))]
        return pa.Table.from_arrays([*own, *others], schema=arrow)

    return _with_blocks(blocks, spans, cut, schema).select(*names, "n_bytes", "removed", "kept")


@query("op1_suffix_array_dedup")
def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, as lengths, and the digest of what is left."""
    result = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda sum, span: sum + span["end"] - span["begin"])
    return result.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
