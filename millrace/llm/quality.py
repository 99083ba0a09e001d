"""Operator 10: quality rules by distribution divergence.

The references are, per language, the histogram of character classes and the histogram of common words over the
whole corpus. A document is compared with each by the Jensen-Shannon divergence (base 2), and the language nearest
to it counts, whatever its own is said to be. Languages with less than a share of the corpus give no reference, so
that their number is bounded; their documents are compared with those of the others and with that of the whole
corpus, and are allowed a margin, as a document strays a little from the words of other languages. Short documents
stray from any reference by chance, so the allowed divergence is larger the fewer words there are, and below a
minimum length all fail.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.folders import stored
from millrace.llm.batches import filter_rows, map_batches
from millrace.llm.registry import query

CLASSES = ("white", "newline", "lower", "upper", "other_letter", "digit", "symbol", "stop", "mark")
WHITE, NEWLINE, LOWER, UPPER, OTHER, DIGIT, SYMBOL, STOP, MARK = range(len(CLASSES))
_SYMBOLS = re.compile(r"[#*$%&|<>]")
TABLE_SIZE = 0x3000
HELD_WORDS = 200_000


@dataclass(frozen=True)
class Limits:
    """When a document is rejected.

    min_words, repeat_percent: the base rule; fewer words, or more words in repeated 3-word windows, fail.
    common_share: words of at least this share of their language's words are its common words, so 1 / common_share
        at most.
    divergence, per_word: rejected above ``divergence + per_word / n_words``.
    class_weight: weight of the divergence of character classes beside that of common words.
    language_share: languages with a smaller share of the corpus' words give no reference, so 1 / language_share do
        at most.
    foreign: how much more a document of such a language may stray.
    """

    min_words: int = 50
    repeat_percent: int = 50
    common_share: float = 1 / 500
    divergence: float = 0.12
    per_word: float = 3.75
    class_weight: float = 1.0
    language_share: float = 0.01
    foreign: float = 0.06


@dataclass(frozen=True)
class References:
    """Histograms by language, that of the whole corpus last: ``classes`` (references x classes), ``words``
    (references x union of common words)."""

    languages: tuple[str, ...]
    classes: np.ndarray
    words: np.ndarray
    place: dict[bytes, int] = field(default_factory=dict)


def class_table() -> np.ndarray:
    """Class of each code point; those beyond the table are other letters."""
    table = np.full(TABLE_SIZE + 1, OTHER, np.uint8)
    for point in range(TABLE_SIZE):
        letter, kind = chr(point), unicodedata.category(chr(point))
        if letter in " \t\v\f\r":
            table[point] = WHITE
        elif letter == "\n":
            table[point] = NEWLINE
        elif _SYMBOLS.match(letter):
            table[point] = SYMBOL
        elif letter in ".,":
            table[point] = STOP
        elif kind[0] == "N":
            table[point] = DIGIT
        elif kind[0] != "L":
            table[point] = MARK
        elif point < 128:
            table[point] = LOWER if kind == "Ll" else UPPER
        else:
            table[point] = UPPER if kind == "Lu" else OTHER
    return table


def class_counts(text: str, table: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount(table[np.minimum(points, TABLE_SIZE)], minlength=len(CLASSES))


def repeated_words(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + 3 - max(at, end)
            end = at + 3
    return covered


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


class CorpusCounter:
    """What one task has counted, by language."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.classes: dict[str | None, np.ndarray] = {}
        self.words: dict[str | None, Counter] = {}

    def __call__(self, batch: pa.RecordBatch):
        for text, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                self.classes[language] = self.classes.get(language, 0) + class_counts(text, self.table)
                self.words.setdefault(language, Counter()).update(text.lower().encode("utf-8", "surrogatepass").split())
        if sum(map(len, self.words.values())) + len(CLASSES) * len(self.classes) >= HELD_WORDS:
            yield from self.finish()

    def finish(self):
        words, classes, self.words, self.classes = self.words, self.classes, {}, {}
        for language, counter in words.items():
            yield from ((language, "word", word, n) for word, n in counter.items())
        for language, counts in classes.items():
            yield from ((language, "class", name.encode(), int(n)) for name, n in zip(CLASSES, counts, strict=True))


def corpus_counts(df: DataFrame, text_column: str = "text", language_column: str = "lang") -> DataFrame:
    """Counts over all texts as ``lang, kind, item, count``: kind ``class`` by class name, ``word`` by lower-case word.

    Tasks count what they read; what they hold is bounded, and flushed when full.
    """

    def start():
        return CorpusCounter(class_table())

    columns = [df[text_column], df[language_column].cast("string")]
    counted = map_batches(df, columns, "lang string, kind string, item binary, count bigint", start)
    return counted.groupBy("lang", "kind", "item").agg(F.sum("count").alias("count"))


def language_references(counts: DataFrame, limits: Limits) -> References:
    """What the driver gets: class counts and common words of at most ``1 / language_share`` languages and of the whole
    corpus, at most ``1 / common_share`` words each. Texts of null language count for the whole corpus alone."""
    whole = counts.groupBy("kind", "item").agg(F.sum("count").alias("count")).withColumn("lang", F.lit(None).cast("string"))
    totals = counts.groupBy(F.col("lang").alias("of"), F.col("kind").alias("of_kind")).agg(F.sum("count").alias("total"))
    sums = {row["of_kind"]: row["total"] for row in totals.groupBy("of_kind").agg(F.sum("total").alias("total")).collect()}
    if not sums.get("word"):
        return References((), np.zeros((0, len(CLASSES))), np.zeros((0, 0)))
    large = totals.where((F.col("of_kind") == "word") & F.col("of").isNotNull() & (F.col("total") >= sums["word"] * limits.language_share))
    languages = sorted(row["of"] for row in large.collect())
    common = (F.col("kind") == "class") | (F.col("count") >= F.col("total") * F.lit(limits.common_share))
    same = (counts["lang"] == totals["of"]) & (counts["kind"] == totals["of_kind"])
    by_language = counts.where(F.col("lang").isin(languages)).join(totals, same).select("lang", "kind", "item", "count", "total")
    total = F.when(F.col("kind") == "word", F.lit(sums["word"])).otherwise(F.lit(sums["class"]))
    rows = by_language.union(whole.withColumn("total", total).select("lang", "kind", "item", "count", "total")).where(common).collect()
    number: dict[str | None, int] = {language: k for k, language in enumerate([*languages, None])}
    place: dict[bytes, int] = {}
    for row in sorted(rows, key=lambda row: bytes(row["item"])):
        if row["kind"] == "word":
            place.setdefault(bytes(row["item"]), len(place))
    classes, words = np.zeros((len(number), len(CLASSES))), np.zeros((len(number), len(place)))
    for row in rows:
        share = row["count"] / row["total"] if row["total"] else 0.0
        if row["kind"] == "class":
            classes[number[row["lang"]], CLASSES.index(bytes(row["item"]).decode())] = share
        else:
            words[number[row["lang"]], place[bytes(row["item"])]] = share
    return References(tuple(languages), classes, words, place)


def divergence(mine: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence of distributions in bits, along the last axis."""
    middle = (mine + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(mine > 0, mine * np.log2(mine / middle), 0) + np.where(reference > 0, reference * np.log2(reference / middle), 0)
    return terms.sum(axis=-1) / 2


def least_divergence(counts: np.ndarray, words: list[bytes], references: References, class_weight: float, foreign: bool = False) -> float:
    """Divergence from the nearest language: that of the common words plus, weighted, that of the classes. The whole
    corpus counts as one for a ``foreign`` document, and where no language has a reference."""
    last = len(references.classes) if foreign or not references.languages else len(references.languages)
    if not last or not words:
        return 0.0
    found = Counter(filter(references.place.__contains__, words))
    share = np.array(list(found.values()), np.float64) / len(words)
    every = references.words[:last]
    theirs = every[:, [references.place[word] for word in found]]
    mine = np.where(theirs > 0, share, 0.0)
    rest = np.stack([1 - mine.sum(axis=1), 1 - every.sum(axis=1)])
    both = np.where((mine > 0) | (theirs > 0), 1, 0)
    by_word = divergence(mine, theirs * both) + divergence(rest[0][:, None], rest[1][:, None])
    # Common words that the document lacks: the reference's share against nothing, one bit a half.
    by_word += (every.sum(axis=1) - theirs.sum(axis=1)) / 2
    by_class = divergence(counts / max(1, counts.sum()), references.classes[:last])
    return float((by_word + class_weight * by_class).min())


@dataclass(frozen=True)
class Verdict:
    """Counts of a text and what follows from them."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    divergence: float
    kept: bool


def judge(text: str, language: str | None, references: References, limits: Limits, table: np.ndarray) -> Verdict:
    words = text.encode("utf-8", "surrogatepass").split()
    counts = class_counts(text, table)
    repeats = repeated_words(words)
    failed = len(words) < limits.min_words or 100 * repeats > limits.repeat_percent * len(words)
    foreign = language is not None and language not in references.languages
    lower = text.lower().encode("utf-8", "surrogatepass").split()
    strays = least_divergence(counts, lower, references, limits.class_weight, foreign)
    allowed = limits.divergence + limits.per_word / max(1, len(words)) + (limits.foreign if foreign else 0.0)
    return Verdict(
        len(words),
        int(counts.sum() - counts[WHITE] - counts[NEWLINE]),
        int(counts[SYMBOL]),
        repeated_lines(text),
        repeats,
        failed,
        strays,
        not failed and strays <= allowed,
    )


def judge_documents(
    df: DataFrame,
    references: References,
    limits: Limits | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
) -> DataFrame:
    """The id and the fields of ``Verdict`` per row of ``df``.

    A null text has no words and fails the base rule. Documents of a language without a reference are compared with
    all and with the whole corpus, and may stray by ``foreign`` more; those of null language are compared with all.
    Equal rows get equal verdicts.
    """
    limits = limits or Limits()

    def start():
        table = class_table()

        def each(batch: pa.RecordBatch):
            for row, text, language in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                verdict = judge(text or "", language, references, limits, table)
                yield (row, *(getattr(verdict, name) for name in Verdict.__dataclass_fields__))

        return each

    kinds = {"int": "bigint", "float": "double", "bool": "boolean"}
    fields = "".join(f", {name} {kinds[f.type]}" for name, f in Verdict.__dataclass_fields__.items())
    schema = f"`{id_column}` {df.schema[id_column].dataType.simpleString()}{fields}"
    return map_batches(df, [df[id_column], df[text_column], df[language_column].cast("string")], schema, start)


def kept_documents(
    df: DataFrame, references: References, limits: Limits | None = None, text_column: str = "text", language_column: str = "lang"
) -> DataFrame:
    """The rows of ``df`` that are kept, all columns."""
    limits = limits or Limits()

    def start():
        table = class_table()

        def wanted(batch: pa.RecordBatch) -> list[bool]:
            columns = (batch.column(name).to_pylist() for name in (text_column, language_column))
            return [judge(text or "", language, references, limits, table).kept for text, language in zip(*columns, strict=True)]

        return wanted

    return filter_rows(df, start)


def corpus_references(df: DataFrame, limits: Limits, text_column: str = "text", language_column: str = "lang") -> References:
    return language_references(stored(corpus_counts(df, text_column, language_column)), limits)


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document, against references made of all documents."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    limits = Limits()
    return judge_documents(documents, corpus_references(documents, limits), limits)
