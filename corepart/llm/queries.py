"""Imports every module that registers a query."""

from __future__ import annotations

from corepart.llm import (  # noqa: F401
    centroid_language,
    euler_tour,
    exact_dedup,
    jaccard_join,
    leak_match,
    learned_partitions,
    max_sketches,
    poisson_mix,
    radix_repeats,
    token_rollup,
    toxicity_chain,
    url_rules,
    warc_chunks,
)
from corepart.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
