"""All core queries and their SQL: importing the query modules registers them."""

from __future__ import annotations

from . import allele_queries, association_queries, dataset_queries, file_queries, format_queries, kernel_queries, score_queries, segment_queries, statistics_queries, variance_queries  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
