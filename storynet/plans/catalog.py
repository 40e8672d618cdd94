"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from storynet.plans import document_queries, event_queries, network_queries, part_queries, plan_queries, resolve_queries, rule_queries, store_queries, text_queries

_PARTS = (network_queries, store_queries, text_queries, event_queries, resolve_queries, rule_queries, part_queries, document_queries, plan_queries)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
