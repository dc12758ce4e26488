"""All registered queries of the library's own operators, with their SQL."""

from __future__ import annotations

from . import build_queries, queries, source_queries, table_queries, walk_queries

QUERIES = queries.QUERIES | build_queries.QUERIES | table_queries.QUERIES | walk_queries.QUERIES | source_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | build_queries.ORACLE_SQL | table_queries.ORACLE_SQL | walk_queries.ORACLE_SQL | source_queries.ORACLE_SQL
