"""All queries outside the llm subpackage, and their oracle SQL."""

from __future__ import annotations

from .plans import concept_queries, fuzzy_queries, lexical_queries, retrieval_queries, search_queries, table_queries, text_queries
from .streaming import jobs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (text_queries, retrieval_queries, table_queries, fuzzy_queries, concept_queries, search_queries, lexical_queries, jobs):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.SQL
