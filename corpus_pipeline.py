"""Training documents from raw ones, in five stages; each works on all that the one before kept.

``run`` applies them to ``documents`` and returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.folders import remove_stored, stored
from millrace.llm.packing import pack_documents
from millrace.llm.quality import Limits, corpus_references, kept_documents
from millrace.llm.repeats import without_repeats
from millrace.llm.simhash import near_duplicate_groups, one_of_each
from millrace.llm.toxicity import clean_documents, learn


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are near to a language of the corpus."""
    limits = Limits()
    return kept_documents(docs, corpus_references(docs, limits), limits)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier, fitted to the labelled ones among them, doesn't call toxic."""
    return clean_documents(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose SimHash fingerprints are two bits apart or less, the document with the smallest id."""
    return one_of_each(docs, near_duplicate_groups(docs))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 100 bytes or more that come earlier; ``n_chars`` is that of the new text."""
    names = [f"_column_{k}" if name not in ("doc_id", "text") else name for k, name in enumerate(docs.columns)]
    numbered = docs.toDF(*names)
    carried = [name for name in names if name not in ("doc_id", "text")]
    kept = without_repeats(numbered, carried=carried, kept_text=True)
    made = {"text": F.col("kept"), "n_chars": F.char_length("kept")}
    columns = [made.get(old, F.col(name)).cast(docs.schema[old].dataType).alias(old) for old, name in zip(docs.columns, names, strict=True)]
    return kept.select(*columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, with their sequences and offsets."""
    return pack_documents(docs)


STAGES = [
    ("quality rules", keep_quality),
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeats),
    ("packing", pack_sequences),
]

#: Fingerprints, a trained classifier and a linear program are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of ``STAGES[-1]``; all stages before return the columns of ``documents``, whatever these are called.

    Null texts have no words and go with the first stage, as do empty ones; null ids, repeated rows and ties are told in
    the docstrings of the operators, and an empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        kept = stored(stage(spark, docs, sf_dir))
        if number:
            remove_stored(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
