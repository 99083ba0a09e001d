"""Operator 2: token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary pieces in a word. Dynamic programming over the word's positions
carries the best score and the number of pieces on the best path, no path itself. Ties fall as in the tokenizers
library: at each position a later candidate replaces an earlier one only if its score is strictly greater, and
candidates come in the order of their first letter.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.batches import map_batches
from millrace.llm.registry import query
from millrace.llm.word_cache import WordCache

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SPACE = "▁"
#: Fixed value of the unigram scheme: what a letter outside the vocabulary costs beyond the worst piece.
UNKNOWN_PENALTY = 10.0


@cache
def unigram_vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """Pieces and scores, by id, of a vocabulary file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()))


class UnigramCounter:
    """Numbers of pieces of texts. Letters outside the vocabulary count as the bytes of their UTF-8.

    A text is cut before each space, the space written as ``SPACE``, with one put first: no piece crosses a cut.
    """

    def __init__(self, vocabulary: Iterable[tuple[str, float]], unknown: int = 0, cached_words: int = 600_000):
        """``unknown`` is the id of the piece for what is outside the vocabulary; its own string is one piece if alone."""
        pieces = list(vocabulary)
        self.unknown_score = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for number, (piece, score) in enumerate(pieces):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, number != unknown))
        self.automaton.make_automaton()
        self.count_of_word = WordCache(lambda word: self.count_word(SPACE + word), cached_words)

    def count_word(self, word: str) -> int:
        # Of the best path to each position: score, pieces, and of the run of unknown letters it ends with, if any,
        # the pieces before and the bytes. A run is its bytes, unless it is just the string of the unknown piece.
        scores, counts, runs = [0.0], [0], [None]

        def unknown(begin: int, size: int, alone: int) -> tuple[int, tuple[int, int]]:
            before, held = runs[begin] or (counts[begin], 0)
            return before + (held + size if held else alone), (before, held + size)

        def close(best: float | None, count: int, run: tuple[int, int] | None, single: bool) -> None:
            """The position after ``len(scores)`` letters is settled; last comes its letter as an unknown one."""
            if not single:
                at = len(scores) - 1
                candidate = self.unknown_score + scores[at]
                if best is None or candidate > best:
                    size = len(word[at].encode())
                    best, (count, run) = candidate, unknown(at, size, size)
            scores.append(best)
            counts.append(count)
            runs.append(run)

        best, count, run, single = None, 0, None, False
        # Ends come in order, and of one end the longest match first: that with the earliest first letter.
        for end, (length, score, known) in self.automaton.iter(word):
            while len(scores) <= end:
                close(best, count, run, single)
                best, count, run, single = None, 0, None, False
            begin = end + 1 - length
            candidate = score + scores[begin]
            if best is None or candidate > best:
                best = candidate
                if known:
                    count, run = counts[begin] + 1, None
                else:
                    count, run = unknown(begin, len(word[begin : end + 1].encode()), 1)
            if length == 1:
                single = True
        while len(scores) <= len(word):
            close(best, count, run, single)
            best, count, run, single = None, 0, None, False
        return counts[-1]

    def count(self, text: str) -> int:
        """Pieces of a whole text; 0 for the empty one."""
        if not text:
            return 0
        first, *rest = text.replace(SPACE, " ").split(" ")
        counts = sum(map(self.count_of_word.__getitem__, rest))
        return counts + (self.count_of_word[first] if first or text[0] not in (" ", SPACE) else 0)


@cache
def unigram_counter(path: str) -> UnigramCounter:
    """One counter per worker process."""
    return UnigramCounter(unigram_vocabulary(path))


def count_tokens(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str = VOCABULARY) -> DataFrame:
    """One row per row of ``df``: its id, ``n_chars`` and ``n_tokens`` of its whole text; a null text is empty and has 0.

    The cost is linear in the text but for the length of pieces; memory is one batch and a bounded cache.
    """

    def start():
        counter = unigram_counter(path)

        def each(batch: pa.RecordBatch):
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield row, len(text or ""), counter.count(text or "")

        return each

    kind = df.schema[id_column].dataType.simpleString()
    return map_batches(df, [df[id_column], df[text_column]], f"`{id_column}` {kind}, n_chars bigint, n_tokens bigint", start)


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole document under the unigram vocabulary."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
