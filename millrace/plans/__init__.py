"""Registered queries and their SQL."""

from __future__ import annotations

from . import catalog, documents, preferences, purchases, rules, stored

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (catalog, purchases, preferences, documents, rules, stored):
    QUERIES |= _part.PLANS.queries
    ORACLE_SQL |= _part.PLANS.sql
