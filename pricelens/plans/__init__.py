"""Queries over the given tables."""

from . import queries, record_queries, page_queries, anchor_queries, stream_queries  # noqa: F401, I001  the others add to the first one's table
