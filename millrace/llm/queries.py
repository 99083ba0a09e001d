"""All queries of this subpackage, registered by importing their modules."""

from millrace.llm import (  # noqa: F401
    centroids,
    encoding,
    packing,
    periods,
    quality,
    repeats,
    shards,
    simhash,
    sketches,
    token_counts,
    toxicity,
    warc,
    winnowing,
)
from millrace.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
