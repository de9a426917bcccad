"""Every registered query of the document engine, with its oracle SQL."""

from __future__ import annotations

from loomwright.plans import block_queries, line_queries, model_queries, text_queries

QUERIES = text_queries.QUERIES | model_queries.QUERIES | block_queries.QUERIES | line_queries.QUERIES
ORACLE_SQL = text_queries.ORACLE_SQL | model_queries.ORACLE_SQL | block_queries.ORACLE_SQL | line_queries.ORACLE_SQL
FLAGSHIP = model_queries.search_top
