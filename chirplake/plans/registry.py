"""All queries of this package but the training-data ones."""

from __future__ import annotations

from chirplake.plans import catalogue_queries, library_queries, recording_queries, search_queries, series_queries, signal_queries, stream_queries

_PARTS = (search_queries, series_queries, catalogue_queries, signal_queries, stream_queries, library_queries, recording_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
