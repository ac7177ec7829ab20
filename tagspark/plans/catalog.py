"""All named queries."""

from __future__ import annotations

from tagspark.plans import (
    browse_queries,
    queue_queries,
    run_queries,
    stream_queries,
    tag_queries,
)
from tagspark.plans.registry import QUERIES, checking_sql

__all__ = [
    "QUERIES",
    "browse_queries",
    "checking_sql",
    "queue_queries",
    "run_queries",
    "stream_queries",
    "tag_queries",
]
