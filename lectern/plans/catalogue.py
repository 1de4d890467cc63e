"""All queries of the library with their SQL."""

from lectern.plans import chunkings, corpus, evaluation, reports, retrieval, upkeep  # noqa: F401
from lectern.plans._registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
