"""Canonical views, and the registered queries with their SQL."""

from . import chunk_queries, model_queries, retrieval_queries, state_queries, store_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "chunk_queries", "model_queries", "retrieval_queries", "state_queries", "store_queries", "text_queries"]
