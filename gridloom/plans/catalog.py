"""All queries of the raster engine and their SQL."""

from __future__ import annotations

from . import format_queries, more_queries, raster_queries, scalar_queries, vector_queries

_PARTS = (raster_queries, scalar_queries, vector_queries, more_queries, format_queries)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL = {k: v for p in _PARTS for k, v in p.SQL.items()}
