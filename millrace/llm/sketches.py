"""Operator 9: document fingerprints by invertible Bloom lookup sketches, in DataFrame functions only.

A text's paragraphs, cut after ``PIECE_WORDS`` words, are hashed to 64-bit digests. Paragraphs of more than ``LONG_LINE``
characters are cut after words whose hash is a multiple of ``CUT_AFTER`` as well: such places depend on the words beside
them alone, so an edit changes the pieces it touches and not all that come after it. The sketch is a small
table of cells, three parts of ``CELLS`` each; every digest is in one cell of each part, and a cell holds how many
digests it has, the exclusive or of them and of their check values. Sketches of two versions are subtracted cell by
cell: what both have goes away. Cells with one digest left, told by the check value, give it; it is taken from its
other cells, and so on until nothing is left. If that fails, the digests are dealt over blocks of about
``BLOCK_DIGESTS``, each with a sketch of its own, and a block that fails still is sketched again with more cells.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.batches import shuffle_partitions
from millrace.llm.registry import query

PIECE_WORDS = 40
LONG_LINE = 1000
CUT_AFTER = 20
CELLS = 8
LARGER = (8, 32, 128)
BLOCK_DIGESTS = 8
PART_BLOCKS = 64
ROUNDS = 16
RANGES = 4
LEAST_ID = -(1 << 63)


def digests(text: str) -> str:
    """The distinct digests of a text's pieces, as an expression."""
    marked = f"array_join(transform(split(line, ' '), word -> if(xxhash64(word) % {CUT_AFTER} = 0, concat(word, '\\n'), word)), ' ')"
    lines = f"array_join(transform(split({text}, '\\n'), line -> if(length(line) > {LONG_LINE}, {marked}, line)), '\\n')"
    cut = f"if(length({text}) > {LONG_LINE}, {lines}, {text})"
    pieces = f"regexp_extract_all({cut}, '[^ \\\\n]+(?: +[^ \\\\n]+){{0,{PIECE_WORDS - 1}}}', 0)"
    return f"array_distinct(transform({pieces}, piece -> xxhash64(piece)))"


def sketch(held: str, cells: int) -> str:
    """Cells of an array of digests: count, exclusive or of digests and of check values."""
    return (
        f"flatten(transform(array(0, 20, 40), shift -> transform(sequence(0L, {cells - 1}L), cell -> "
        f"aggregate(filter({held}, x -> (shiftrightunsigned(x, shift) & {cells - 1}L) = cell), "
        "named_struct('n', 0, 'k', 0L, 'c', 0), "
        "(sum, x) -> named_struct('n', sum.n + 1, 'k', sum.k ^ x, 'c', sum.c ^ hash(x))))))"
    )


def difference(left: str, right: str) -> str:
    return f"zip_with({left}, {right}, (a, b) -> named_struct('n', a.n - b.n, 'k', a.k ^ b.k, 'c', a.c ^ b.c))"


def peeled(left: str, cells: int) -> str:
    """What a difference of sketches holds: digests only the first has, and only the second; null if it can't be told."""
    pure = (
        "array_distinct(transform(filter(state.cells, c -> abs(c.n) = 1 and hash(c.k) = c.c), "
        "c -> named_struct('k', c.k, 'n', c.n)))"
    )
    mine = f"(shiftrightunsigned(r.k, 20 * cast(at div {cells} as int)) & {cells - 1}L) = at % {cells}"
    without = (
        f"transform(state.cells, (c, at) -> aggregate(filter(found, r -> {mine}), c, "
        "(sum, r) -> named_struct('n', sum.n - r.n, 'k', sum.k ^ r.k, 'c', sum.c ^ hash(r.k))))"
    )
    more = "concat(state.{0}, transform(filter(found, r -> r.n = {1}), r -> r.k))"
    after = f"named_struct('cells', {without}, 'plus', {more.format('plus', 1)}, 'minus', {more.format('minus', -1)})"
    none = "cast(array() as array<bigint>)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('cells', {left}, 'plus', {none}, 'minus', {none}), "
        f"(state, round) -> transform(array({pure}), found -> if(size(found) = 0, state, {after}))[0], "
        "state -> if(forall(state.cells, c -> c.n = 0 and c.k = 0L and c.c = 0), "
        "named_struct('plus', state.plus, 'minus', state.minus), null))"
    )


def in_blocks(left: str, right: str) -> str:
    """The differing digests by sketches of blocks; with many blocks, parts of ``PART_BLOCKS`` blocks are cut off first.

    A block for which no number of cells is enough is compared digest by digest.
    """
    total = f"(size({left}) + size({right}))"
    blocks = f"greatest(1, least({PART_BLOCKS}, {total} div {BLOCK_DIGESTS}))"
    parts = f"(1 + {total} div {BLOCK_DIGESTS * PART_BLOCKS})"
    in_part = "filter({0}, x -> pmod(xxhash64(x, 1), {1}) = part)"
    in_block = "filter({0}, x -> pmod(xxhash64(x, 2), {1}) = block)"
    tries = ", ".join(peeled(difference(sketch("both.a", cells), sketch("both.b", cells)), cells) for cells in LARGER)
    exact = "named_struct('plus', array_except(both.a, both.b), 'minus', array_except(both.b, both.a))"
    block = f"transform(array(named_struct('a', {in_block.format('of.a', blocks)}, 'b', {in_block.format('of.b', blocks)})), both -> coalesce({tries}, {exact}))[0]"
    part = (
        f"transform(array(named_struct('a', {in_part.format(left, parts)}, 'b', {in_part.format(right, parts)})), "
        f"of -> transform(sequence(0, cast({blocks} as int) - 1), block -> {block}))[0]"
    )
    every = f"flatten(transform(sequence(0, cast({parts} as int) - 1), part -> {part}))"
    joined = "flatten(transform(blocks, block -> block.{0}))"
    return f"transform(array({every}), blocks -> named_struct('plus', {joined.format('plus')}, 'minus', {joined.format('minus')}))[0]"


def likeness(held: str, changed: str) -> str:
    """Digests in both, of those in either; 1 if there are none."""
    every = f"(size({held}) + size({changed}.minus))"
    return f"if({every} = 0, 1.0D, cast(size({held}) - size({changed}.plus) as double) / {every})"


def printed(cells: str) -> str:
    """A sketch as hex digits, cell by cell."""
    return f"array_join(transform({cells}, c -> concat(lpad(hex(c.n), 8, '0'), lpad(hex(c.k), 16, '0'), lpad(hex(c.c & 4294967295L), 8, '0'))), '')"


def with_following_text(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id, text, following``: the text of the row after it by falling id, of the last row that of the first.

    Rows are dealt by ranges of ids of about equal counts, some for each shuffle partition, and a window runs within
    each; the row after a range's last is the first of the range below, which is sent there in copy.
    The driver gets the ranges' bounds and largest ids. Null ids come last; rows with one id follow by their text,
    null texts being empty.
    """
    rows = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", F.coalesce("id", F.lit(LEAST_ID)).cast("long"))
    number = RANGES * shuffle_partitions(df.sparkSession)
    shares = F.array(*[F.lit(k / number) for k in range(1, number)]) if number > 1 else F.array(F.lit(0.5))
    found = keyed.agg(F.percentile_approx("key", shares, 10 * number).alias("bounds")).first()["bounds"]
    bounds = sorted(set(found or [0]))
    ranged = keyed.withColumn("range", range_of(F.col("key"), bounds))
    tops = {row["range"]: row["top"] for row in ranged.groupBy("range").agg(F.max("key").alias("top")).collect()}
    filled = sorted(tops) or [0]
    above = dict(zip(filled, [*filled[1:], filled[0]], strict=True))
    # One literal each, whatever number of ranges there is; ranges without rows are never looked up.
    top = F.lit(np.array([tops.get(k, LEAST_ID) for k in range(len(bounds) + 1)], np.int64))
    target = F.lit(np.array([above.get(k, 0) for k in range(len(bounds) + 1)], np.int32))
    own = F.struct(F.col("range"), F.lit(False).alias("copy"))
    sent = F.struct(target[F.col("range")].alias("range"), F.lit(True).alias("copy"))
    places = F.when(F.col("key") == top[F.col("range")], F.array(own, sent)).otherwise(F.array(own))
    placed = ranged.withColumn("place", F.explode(places)).select("id", "text", "key", "place.range", "place.copy")
    order = Window.partitionBy("range").orderBy("copy", F.desc("key"), "text")
    return placed.withColumn("following", F.lead("text").over(order)).where("not copy").select("id", "text", "following")


def range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are below the key, by halving."""
    listed = F.lit(np.array(bounds, np.int64))
    steps = F.sequence(F.lit(1), F.lit(max(1, len(bounds)).bit_length()))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        up = F.struct((middle + 1).alias("low"), state["high"].alias("high"))
        down = F.struct(state["low"].alias("low"), middle.alias("high"))
        return F.when(state["low"] >= state["high"], state).when(listed[middle] < key, up).otherwise(down)

    whole = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(steps, whole, halve, lambda state: state["low"])


def compare_sketches(df: DataFrame, text_columns: list[str]) -> DataFrame:
    """``df`` with ``digests_<c>`` and ``sketch_<c>`` for each text column ``c``, and for each but the first
    ``changed_<c>``: the digests only the first text has (``plus``) and only this one (``minus``)."""
    first, *others = text_columns
    hashed = df.withColumns({f"digests_{c}": F.expr(digests(c)) for c in text_columns})
    sketched = hashed.withColumns({f"sketch_{c}": F.expr(sketch(f"digests_{c}", CELLS)) for c in text_columns})
    small = {f"changed_{c}": F.expr(peeled(difference(f"sketch_{first}", f"sketch_{c}"), CELLS)) for c in others}
    tried = sketched.withColumns(small)
    retried = {f"changed_{c}": F.expr(f"coalesce(changed_{c}, {in_blocks(f'digests_{first}', f'digests_{c}')})") for c in others}
    return tried.withColumns(retried)


def document_fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, the likeness of the two, and that to the following text.

    The edited form has the last third of the text (rounded down, in code points) replaced by as many, or all, of
    the first of the following text. A null text is empty; texts without words are equal to each other. Equal rows
    give a row each.
    """
    rows = with_following_text(df, id_column, text_column)
    third = "cast(n_chars div 3 as int)"
    edited = f"concat(substring(text, 1, cast(n_chars as int) - {third}), substring(following, 1, {third}))"
    versions = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", F.expr(edited))
    compared = compare_sketches(versions, ["text", "edited", "following"])
    return compared.select(
        F.col("id").alias(id_column),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.expr(printed("sketch_text")).alias("fingerprint"),
        F.expr(printed("sketch_edited")).alias("edited_fingerprint"),
        F.expr(likeness("digests_text", "changed_edited")).alias("near_edited"),
        F.expr(likeness("digests_text", "changed_following")).alias("near_next"),
    )


@query("op9_document_fingerprints")
def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents."""
    return document_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
