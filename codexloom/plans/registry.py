"""All registered queries of the library."""

from codexloom.plans import attribution_queries, corpus_queries, ledger_queries, retrieval_queries, stream_queries, tree_queries  # noqa: F401
from codexloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
