"""Operator 5: toxicity by a convolutional text classifier, trained in numpy.

Words are hashed to buckets with embeddings; filters of several widths run over them, the largest response of each
filter in the text goes to a logistic layer. The classifier is fitted to all labelled documents, by tasks that each
descend over some of them; after each round Spark takes the mean of what they found. It scores whole texts inside the
tasks. Thresholds are calibrated by language, which is told from the letters of the text itself, and are built into the
score: 0.5 is the threshold in each. They come from documents that the weights were not fitted to.
"""

from __future__ import annotations

import copy
import math
import string
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.folders import remove_stored, stored
from millrace.llm.batches import filter_rows, find_package_in_workers, map_batches
from millrace.llm.registry import query
from millrace.llm.word_cache import WordCache
from millrace.operators.broadcasts import BROADCAST_ROWS, may_match

BUCKETS = 1 << 22
WIDTHS = (1, 2, 3)
_EDGES = string.punctuation + "¿¡«»„“”‘’…–—"
#: Letters that tell languages apart; a text with few of them is of the first group.
LANGUAGE_LETTERS = {"plain": "", "de": "äöüß", "es": "ñíóáú", "fr": "èêçàâîôûë"}
LETTER_SHARE = 0.002
#: One in so many labelled documents gives thresholds, not weights.
KEPT_BACK = 5
#: Changes of parameters are added up as multiples of 2^-FRACTION_BITS.
FRACTION_BITS = 24
#: Logits are counted to a STEPS-th for thresholds, up to LARGEST.
STEPS, LARGEST = 1024, 64


@dataclass(frozen=True)
class Training:
    """Settings of the fit.

    shard_texts, shard_words: about how many texts, and at most how many words in the mean, one task descends over
        before the mean is taken. They set the number of shards; every text is in one.
    rows, seen_in, toxic_share: the buckets with embeddings of their own, at most ``rows``, each in this share of the
        texts and in three at least; rarer words would only be learned by heart. Shares are what they would be if
        ``toxic_share`` of the texts were toxic, so that rare toxic words count where few texts are toxic.
    """

    shard_texts: int = 8000
    shard_words: int = 8_000_000
    rows: int = 50_000
    seen_in: float = 1 / 800
    toxic_share: float = 1 / 3
    size: int = 8
    filters: int = 8
    epochs: int = 10
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-5
    seed: int = 5


@dataclass
class Classifier:
    """``buckets`` (sorted) have rows 1.. of ``embedding``; row 0 is zero and stands for all other words.

    ``learned_from``: how many texts weights and thresholds come from.
    """

    buckets: np.ndarray
    embedding: np.ndarray
    kernels: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    intercept: float
    thresholds: dict[str, float] = field(default_factory=dict)
    learned_from: int = 0

    def rows(self, buckets: np.ndarray) -> np.ndarray:
        if not len(self.buckets):
            return np.zeros(len(buckets), np.int64)
        at = np.minimum(np.searchsorted(self.buckets, buckets), len(self.buckets) - 1)
        return np.where(self.buckets[at] == buckets, at + 1, 0)

    def logits(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        """One per text, each given as its words' rows."""
        tables = [[self.embedding @ step for step in kernel] for kernel in self.kernels]
        rows, starts, ends = laid_out(texts)
        borders = np.stack([starts, ends], axis=1).ravel()
        pooled = [
            np.maximum.reduceat(responses(rows, table) + bias, borders, axis=0)[::2]
            for table, bias in zip(tables, self.biases, strict=True)
        ]
        return np.maximum(np.concatenate(pooled, axis=1), 0) @ self.weights + self.intercept


def bucket_of_word(word: str) -> int:
    return zlib.crc32(word.strip(_EDGES).lower().encode("utf-8", "surrogatepass")) % BUCKETS


def language_group(text: str) -> str:
    """Told from the letters alone."""
    lower = text.lower()
    found = {name: sum(map(lower.count, letters)) for name, letters in LANGUAGE_LETTERS.items()}
    name = max(found, key=found.__getitem__)
    return name if found[name] > LETTER_SHARE * len(text) else "plain"


def laid_out(texts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other, each followed by zeros; where each begins, and where its places end.

    The place after a text is its own too, so that the empty text has one; no filter reaches the next text from there.
    """
    gap = max(WIDTHS)
    sizes = np.array([len(text) + gap for text in texts])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    rows = np.zeros(int(sizes.sum()), np.int64)
    for start, text in zip(starts, texts, strict=True):
        rows[start : start + len(text)] = text
    return rows, starts, starts + sizes - gap + 1


def responses(rows: np.ndarray, table: list[np.ndarray]) -> np.ndarray:
    """Of one width's filters at every position, from the filters' responses to each row at each step."""
    found = table[0][rows]
    for step in range(1, len(table)):
        found[:-step] += table[step][rows[step:]]
    return found


def train(texts: Sequence[np.ndarray], labels: np.ndarray, groups: Sequence[str], settings: Training) -> Classifier:
    """Fit to texts given as arrays of buckets, as ``learn`` does with one shard, but with every fifth kept back."""
    own = [np.unique(text) for text in texts]
    seen, place = np.unique(np.concatenate(own or [np.zeros(0, np.int64)]), return_inverse=True)
    toxic = np.bincount(place, np.repeat(labels, [len(text) for text in own]), len(seen))
    clean = np.bincount(place, minlength=len(seen)) - toxic
    model = beginning(frequent_buckets(seen, clean, toxic, len(texts) - labels.sum(), labels.sum(), settings), settings)
    if not len(labels) or labels.min() == labels.max():
        return all_clean(model)
    rows = [model.rows(text) for text in texts]
    kept_back = np.arange(len(rows)) % KEPT_BACK == KEPT_BACK - 1
    weight = class_weights(len(labels) - labels.sum(), labels.sum())[labels]
    learned_from = np.flatnonzero(~kept_back)
    descend(model, [rows[i] for i in learned_from], labels[learned_from], weight[learned_from], settings, range(settings.epochs))
    scores = np.concatenate([model.logits(rows[i : i + 256]) for i in range(0, len(rows), 256)])
    if not enough(kept_back.sum() - labels[kept_back].sum(), labels[kept_back].sum()):
        kept_back[:] = True  # too few to calibrate on
    tallies = {
        name: (scores[mine], labels[mine], np.ones(mine.sum()))
        for name in LANGUAGE_LETTERS
        for mine in [np.array([group == name for group in groups]) & kept_back]
    }
    return calibrated(model, tallies)


def frequent_buckets(
    seen: np.ndarray, clean: np.ndarray, toxic: np.ndarray, clean_texts: int, toxic_texts: int, settings: Training
) -> np.ndarray:
    """Of buckets and the number of clean and toxic texts that each is in, those with embeddings of their own; sorted."""
    share = (1 - settings.toxic_share) * clean / max(1, clean_texts) + settings.toxic_share * toxic / max(1, toxic_texts)
    frequent = np.lexsort((seen, -share))
    return np.sort(seen[frequent[((share >= settings.seen_in) & (clean + toxic >= 3))[frequent]][: settings.rows]])


def beginning(buckets: np.ndarray, settings: Training) -> Classifier:
    random = np.random.default_rng(settings.seed)
    size, filters = settings.size, settings.filters
    model = Classifier(
        buckets,
        random.normal(0, 0.1, (len(buckets) + 1, size)).astype(np.float32),
        [random.normal(0, 0.3, (width, size, filters)).astype(np.float32) for width in WIDTHS],
        [np.full(filters, 0.05, np.float32) for _ in WIDTHS],
        random.normal(0, 0.3, filters * len(WIDTHS)).astype(np.float32),
        -3.0,
    )
    model.embedding[0] = 0
    return model


def all_clean(model: Classifier) -> Classifier:
    """Without both classes nothing can be learned: everything is called clean."""
    model.weights[:] = 0
    return model


def class_weights(clean: int, toxic: int) -> np.ndarray:
    """Both classes weigh the same in all."""
    return np.array([(clean + toxic) / (2 * clean), (clean + toxic) / (2 * toxic)])


def descend(
    model: Classifier, rows: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, settings: Training, epochs: Sequence[int], shard: int = 0
) -> None:
    """Once an epoch over all texts, given as their words' rows, in an order drawn for it; ``model`` is changed."""
    parameters = [model.embedding, *model.kernels, *model.biases, model.weights]
    means, squares = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    step = 0
    for epoch in epochs:
        order = np.random.default_rng([settings.seed, epoch, shard]).permutation(len(rows))
        for begin in range(0, len(order), settings.batch):
            chosen = order[begin : begin + settings.batch]
            gradients, intercept = gradient(model, [rows[i] for i in chosen], labels[chosen], weight[chosen])
            step += 1
            model.intercept -= settings.rate * intercept
            for p, g, mean, square in zip(parameters, gradients, means, squares, strict=True):
                g += settings.decay * p
                mean += 0.1 * (g - mean)
                square += 0.001 * (g * g - square)
                p -= settings.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
            model.embedding[0] = 0


def enough(clean: int, toxic: int) -> bool:
    """Whether a threshold can be told from so many."""
    return clean >= 10 and toxic >= 10


def calibrated(model: Classifier, tallies: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Classifier:
    """``model`` with thresholds from, by language, scores, and at each how many are toxic and how many there are."""
    overall = best_threshold(*[np.concatenate(column) for column in zip(*tallies.values(), strict=True)])
    for name, (scores, toxic, texts) in tallies.items():
        own = enough(texts.sum() - toxic.sum(), toxic.sum())
        model.thresholds[name] = best_threshold(scores, toxic, texts) if own else overall
    return model


def gradient(model: Classifier, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], float]:
    """Of the weighted logistic loss; only the positions that won the pooling carry it back."""
    rows, starts, ends = laid_out(texts)
    filters = len(model.biases[0])
    winners, tops = [], []
    for kernel, bias in zip(model.kernels, model.biases, strict=True):
        found = responses(rows, [model.embedding @ step for step in kernel]) + bias
        at = np.stack([start + found[start:end].argmax(axis=0) for start, end in zip(starts, ends, strict=True)])
        winners.append(at)
        tops.append(np.take_along_axis(found, at, axis=0))
    pooled = np.concatenate(tops, axis=1)
    active = np.maximum(pooled, 0)
    error = weight * (1 / (1 + np.exp(-(active @ model.weights + model.intercept))) - labels) / len(labels)
    back = (error[:, None] * model.weights[None, :] * (pooled > 0)).astype(np.float32)
    embedding = np.zeros_like(model.embedding)
    kernels, biases = [], []
    for k, (width, at) in enumerate(zip(WIDTHS, winners, strict=True)):
        mine = back[:, k * filters : (k + 1) * filters]
        change = np.zeros_like(model.kernels[k])
        for step in range(width):
            there = rows[np.minimum(at + step, len(rows) - 1)]
            there[at + step >= len(rows)] = 0
            change[step] = np.einsum("tf,tfs->sf", mine, model.embedding[there])
            np.add.at(embedding, there.ravel(), (mine[:, :, None] * model.kernels[k][step].T[None]).reshape(-1, embedding.shape[1]))
        kernels.append(change)
        biases.append(mine.sum(axis=0))
    return [embedding, *kernels, *biases, (error @ active).astype(np.float32)], float(error.sum())


def best_threshold(scores: np.ndarray, toxic: np.ndarray, texts: np.ndarray | None = None) -> float:
    """Where F1 is best; between the scores around it, so that neither class lies on the border.

    ``toxic`` of ``texts`` (else one) texts have each score. Equal scores are on the same side.
    """
    scores, place = np.unique(-scores, return_inverse=True)
    scores = -scores
    hits = np.cumsum(np.bincount(place, toxic, len(scores)))
    called = np.cumsum(np.bincount(place, texts, len(scores)))
    if not len(scores) or not hits[-1]:
        return 0.0
    last = int((2 * hits / (called + hits[-1])).argmax())
    following = scores[last + 1] if last + 1 < len(scores) else scores[last] - 1
    return float((scores[last] + following) / 2)


def _words(cached: int = 100_000) -> WordCache:
    return WordCache(bucket_of_word, cached)


def learn(
    documents: DataFrame, labels: DataFrame, settings: Training | None = None, id_column: str = "doc_id", text_column: str = "text"
) -> Classifier:
    """Fit to ``labels`` (``doc_id, toxic``) of documents that may be learned from: crc32 of the id, mod 5, not 0.

    All of them are learned from: of each five, by hash of the id, four give the weights and one the thresholds. Texts
    stay in the tasks; the driver gets how many texts have a word, the means of the shards' parameters, and how
    many texts have a score, rounded. Null ids, labels and texts teach nothing; of several labels of a document the
    largest counts. The result does not depend on how rows are dealt over tasks.
    """
    settings = settings or Training()
    encoded = stored(_encoded(documents, labels, settings, id_column, text_column))
    try:
        return _fitted(encoded, settings)
    finally:
        remove_stored(encoded)


def _encoded(documents: DataFrame, labels: DataFrame, settings: Training, id_column: str, text_column: str) -> DataFrame:
    """The labelled texts as words' buckets: ``place`` (by hash of the id), ``toxic, words, language, kept_back``."""
    key = F.col("__known")
    known = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).where(F.col("toxic").isin(0, 1))
    known = known.groupBy(F.col("doc_id").alias("__known")).agg(F.max("toxic").cast("int").alias("__toxic"))
    texts = documents.select(documents[id_column].alias("__id"), documents[text_column].alias("__text")).where("__text is not null")
    rows = known.count()
    if rows > BROADCAST_ROWS:
        texts = may_match(texts, known, {"__id": "__known"}, rows)
    found = texts.join(F.broadcast(known) if rows <= BROADCAST_ROWS else known, F.col("__id") == key)
    place = F.xxhash64(F.lit(settings.seed), key)
    kept_back = F.pmod(F.xxhash64(F.lit("kept back"), key), F.lit(KEPT_BACK)) == 0

    def start():
        words = _words()

        def each(batch: pa.RecordBatch):
            place, toxic, back, texts = (batch.column(k).to_pylist() for k in range(4))
            for number, label, kept, text in zip(place, toxic, back, texts, strict=True):
                yield number, label, kept, language_group(text), np.array([words[word] for word in text.split()], "<u4").tobytes()

        return each

    schema = "place long, toxic int, kept_back boolean, language string, words binary"
    return map_batches(found, [place, F.col("__toxic"), kept_back, F.col("__text")], schema, start)


def _fitted(encoded: DataFrame, settings: Training) -> Classifier:
    counts = {
        (row["kept_back"], row["toxic"]): (row["texts"], row["words"])
        for row in encoded.groupBy("kept_back", "toxic").agg(F.count("*").alias("texts"), F.sum(F.length("words") / 4).alias("words")).collect()
    }
    every = [sum(texts for (_, toxic), (texts, _) in counts.items() if toxic == k) for k in (0, 1)]
    model = beginning(_vocabulary(encoded, *every, settings), settings)
    back, (clean, toxic) = ([counts.get((kept, k), (0, 0)) for k in (0, 1)] for kept in (True, False))
    if not clean[0] or not toxic[0]:
        return all_clean(model)
    model.learned_from = sum(every)
    shards = math.ceil(max((clean[0] + toxic[0]) / settings.shard_texts, (clean[1] + toxic[1]) / settings.shard_words))
    weight = class_weights(clean[0], toxic[0])
    dealt = stored(_dealt(encoded.where("not kept_back"), model, shards))
    try:
        every_epoch = range(settings.epochs)
        # One shard has no other to wait for.
        for epochs in [every_epoch] if shards == 1 else [[epoch] for epoch in every_epoch]:
            model = _after_round(dealt, model, weight, clean[0] + toxic[0], settings, epochs)
    finally:
        remove_stored(dealt)
    # With too few kept back, all of them calibrate.
    return calibrated(model, _tallies(encoded.where("kept_back") if enough(back[0][0], back[1][0]) else encoded, model))


def _vocabulary(encoded: DataFrame, clean_texts: int, toxic_texts: int, settings: Training) -> np.ndarray:
    """The buckets with embeddings of their own, by the number of all texts that have them."""

    def start():
        def each(batch: pa.RecordBatch):
            words, toxic = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            own = [np.unique(np.frombuffer(text, "<u4")) for text in words]
            found, place = np.unique(np.concatenate(own), return_inverse=True)
            hits = np.bincount(place, np.repeat(toxic, [len(text) for text in own]), len(found)).astype(np.int64)
            return zip(found.tolist(), (np.bincount(place, minlength=len(found)) - hits).tolist(), hits.tolist(), strict=True)

        return each

    counted = map_batches(encoded, [F.col("words"), F.col("toxic")], "bucket long, clean long, toxic long", start)
    summed = counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # Shares of all buckets add up to the words of a text in the mean, so no more than that over ``seen_in`` come to the driver.
    share = F.col("clean") * ((1 - settings.toxic_share) / max(1, clean_texts)) + F.col("toxic") * (settings.toxic_share / max(1, toxic_texts))
    frequent = summed.where((share >= 0.999 * settings.seen_in) & (F.col("clean") + F.col("toxic") >= 3)).collect()
    seen, clean, toxic = (np.array([row[name] for row in frequent], np.int64) for name in ("bucket", "clean", "toxic"))
    return frequent_buckets(seen, clean, toxic, clean_texts, toxic_texts, settings)


def _dealt(encoded: DataFrame, model: Classifier, shards: int) -> DataFrame:
    """One row per shard, with its texts as rows of the embedding, in an order that their ids set."""

    def start():
        def each(batch: pa.RecordBatch):
            place, toxic, words = (batch.column(k).to_pylist() for k in range(3))
            for number, label, text in zip(place, toxic, words, strict=True):
                yield number, label, model.rows(np.frombuffer(text, "<u4").astype(np.int64)).astype("<u4").tobytes()

        return each

    rows = map_batches(encoded, [F.col(name) for name in ("place", "toxic", "words")], "place long, toxic int, words binary", start)
    shard = F.pmod(F.xxhash64("place"), F.lit(shards)).alias("shard")
    return rows.groupBy(shard).agg(F.sort_array(F.collect_list(F.struct("place", "toxic", "words"))).alias("texts"))


def _after_round(dealt: DataFrame, model: Classifier, weight: np.ndarray, texts: int, settings: Training, epochs: Sequence[int]) -> Classifier:
    """``model`` after each shard has descended from it: the mean of all, by their texts.

    Changes are whole numbers when they are added up, so the sum does not depend on the order.
    """
    former = flat(model, settings.size)
    # Parameters are float32, the texts of all shards are far below 2^33: sums stay below 2^63.
    names = [f"p{k}" for k in range(settings.size)]
    schema = pa.schema([("at", pa.int64()), *[(name, pa.int64()) for name in names]])
    held = dealt.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros(former.shape, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column(1)[k].values
                labels = own.field("toxic").to_numpy().astype(np.int64)
                rows = [np.frombuffer(text.as_buffer(), "<u4").astype(np.int64) for text in own.field("words")]
                mine = copy.deepcopy(held.value)
                descend(mine, rows, labels, weight[labels], settings, epochs, batch.column(0)[k].as_py())
                change += np.rint((flat(mine, settings.size) - former) * (1 << FRACTION_BITS)).astype(np.int64) * len(rows)
        changed = np.flatnonzero(change.any(axis=1))
        for begin in range(0, len(changed), 4096):
            at = changed[begin : begin + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(column) for column in change[at].T]], schema=schema)

    find_package_in_workers(dealt.sparkSession)
    moved = dealt.mapInArrow(run, ", ".join(f"{name} long" for name in ("at", *names)))
    change = np.zeros(former.shape)
    for row in moved.groupBy("at").agg(*[F.sum(name).alias(name) for name in names]).toLocalIterator():
        change[row["at"]] = row[1:]
    held.unpersist()
    return unflattened(model, former + change / (texts * float(1 << FRACTION_BITS)))


def flat(model: Classifier, size: int) -> np.ndarray:
    """All parameters, in rows of ``size``; the first are the embedding's."""
    rest = np.concatenate([p.ravel() for p in (*model.kernels, *model.biases, model.weights, np.array([model.intercept]))])
    return np.concatenate([model.embedding, np.pad(rest, (0, -len(rest) % size)).reshape(-1, size)]).astype(np.float64)


def unflattened(model: Classifier, parameters: np.ndarray) -> Classifier:
    """``model`` with other parameters."""
    made = copy.deepcopy(model)
    made.embedding[...] = parameters[: len(made.embedding)]
    rest, at = parameters[len(made.embedding) :].ravel(), 0
    for p in (*made.kernels, *made.biases, made.weights):
        p[...] = rest[at : at + p.size].reshape(p.shape)
        at += p.size
    made.intercept = float(rest[at])
    return made


def _tallies(encoded: DataFrame, model: Classifier) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By language the scores of texts, rounded, with the number of toxic ones and of all."""

    def start():
        def each(batch: pa.RecordBatch):
            language, toxic, words = (batch.column(k).to_pylist() for k in range(3))
            for begin in range(0, len(words), 256):
                rows = [model.rows(np.frombuffer(text, "<u4").astype(np.int64)) for text in words[begin : begin + 256]]
                steps = np.rint(np.clip(model.logits(rows), -LARGEST, LARGEST) * STEPS).astype(np.int64).tolist()
                yield from zip(language[begin : begin + 256], toxic[begin : begin + 256], steps, strict=True)

        return each

    scored = map_batches(encoded, [F.col(name) for name in ("language", "toxic", "words")], "language string, toxic int, step long", start)
    counted = scored.groupBy("language", "step").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("texts")).collect()
    return {
        name: tuple(np.array([row[column] for row in counted if row["language"] == name], float) / divisor for column, divisor in (("step", STEPS), ("toxic", 1), ("texts", 1)))
        for name in LANGUAGE_LETTERS
    }


def scores_of(model: Classifier, words: WordCache, texts: list[str | None]) -> np.ndarray:
    """Scores from 0 to 1 of whole texts, some hundreds at a time."""
    found = [np.zeros(0)]
    for begin in range(0, len(texts), 256):
        mine = [text or "" for text in texts[begin : begin + 256]]
        rows = [model.rows(np.array(list(map(words.__getitem__, text.split())), np.int64)) for text in mine]
        border = np.array([model.thresholds.get(language_group(text), 0.0) for text in mine])
        found.append(1 / (1 + np.exp(-np.clip(model.logits(rows) - border, -30, 30).astype(np.float64))))
    return np.concatenate(found)


def score_documents(documents: DataFrame, model: Classifier, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of each whole text; a null text is empty.

    Nothing but the text goes into a score. Repeated rows get equal scores.
    """

    def start():
        words = _words()

        def each(batch: pa.RecordBatch):
            scores = scores_of(model, words, batch.column(1).to_pylist())
            yield from zip(batch.column(0).to_pylist(), scores.tolist(), (scores >= 0.5).astype(int).tolist(), strict=True)

        return each

    schema = f"`{id_column}` {documents.schema[id_column].dataType.simpleString()}, score double, predicted int"
    return map_batches(documents, [documents[id_column], documents[text_column]], schema, start)


def clean_documents(documents: DataFrame, model: Classifier, text_column: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, all columns."""

    def start():
        words = _words()
        return lambda batch: (scores_of(model, words, batch.column(text_column).to_pylist()) < 0.5).tolist()

    return filter_rows(documents, start)


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, and which of them could not be learned from."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return score_documents(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
