"""Small documents with everything that may go wrong, and what several tests need."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns that operators use for results of their own.
CLASHING = ["n_tokens", "ids", "rank", "size", "sequence_id", "offset", "fingerprint", "component_id", "kept", "block", "copy", "shard", "slot", "score", "bucket"]
CLASHING += ["removed", "n_bytes", "chosen", "_text_hash", "text_hash", "_id", "_hash", "component", "words", "divergence"]
COMMON = ["the", "of", "and", "to", "in"]
STEMS = ["".join(random.Random(k).choices("abcdeéghiklmnoprstuü", k=2 + k % 9)) for k in range(2000)]


def prose(seed: int, words: int) -> str:
    """Sentences of invented words, some of them frequent."""
    chosen = random.Random(seed)
    lines, line = [], []
    for _ in range(words):
        line.append(chosen.choice(COMMON) if chosen.random() < 0.3 else chosen.choice(STEMS))
        if chosen.random() < 0.08:
            lines.append(" ".join(line).capitalize() + ".")
            line = []
    return "\n".join([*lines, " ".join(line)])


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, copies, near copies, ties and repeated rows."""
    texts = [prose(k, 20 + 15 * k) for k in range(24)]
    rows = [(k, text, "en" if k % 3 else "fr", f"src{k % 3}", len(text)) for k, text in enumerate(texts)]
    rows += [(100 + k, texts[5], "en", "src0", len(texts[5])) for k in range(12)]
    rows += [(200 + k, texts[9] + f"\nNote {k}.", "en", "src0", 0) for k in range(6)]
    rows += [
        (300, None, None, None, None),
        (301, "", "en", "src1", 0),
        (302, " \n\t \n ", "en", "src1", 6),
        (303, "ab " * 30_000, "en", "src1", 90_000),
        (304, "x" * 20_000, "en", "src1", 20_000),
        (305, "😀 naïve café <|endoftext|> 中文 \x00 end", "en", None, 1),
        (306, "one", "de", "src2", 3),
        (None, texts[3], "en", "src2", 1),
        (7, texts[7], "en", "src1", 1),
        (7, texts[7], "en", "src1", 1),
    ]
    return rows


def documents(spark, rows: list[tuple] | None = None, clashing: bool = False):
    df = spark.createDataFrame(awkward_rows() if rows is None else rows, DOCUMENTS).repartition(3)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({name: F.lit("clash") for name in CLASHING})
    return df


def ordered(rows) -> list[tuple]:
    return sorted(map(tuple, rows), key=repr)
