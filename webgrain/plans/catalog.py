"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import content, logs, pages, service, streams

QUERIES = pages.QUERIES | logs.QUERIES | content.QUERIES | streams.QUERIES | service.QUERIES
SQL = pages.SQL | logs.SQL | content.SQL | streams.SQL | service.SQL
