"""All registered queries of this package."""

from __future__ import annotations

from clipatlas.llm import conversation_queries, corpus_queries, duplicate_queries, native_queries, vector_queries
from clipatlas.llm.registry import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES", "conversation_queries", "corpus_queries", "duplicate_queries", "native_queries", "vector_queries"]
