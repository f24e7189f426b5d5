"""Queries of the library's own operators and their SQL."""

from __future__ import annotations

from tessera.plans import queries_features, queries_models, queries_tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (queries_tables, queries_features, queries_models):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
