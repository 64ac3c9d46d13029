"""Registered queries over the driver tables, and their SQL."""

from __future__ import annotations

from . import contract_queries, evaluation_queries, rollup_queries, scene_queries

QUERIES = evaluation_queries.QUERIES | scene_queries.QUERIES | rollup_queries.QUERIES | contract_queries.QUERIES
ORACLES = evaluation_queries.ORACLES | scene_queries.ORACLES | rollup_queries.ORACLES | contract_queries.ORACLES
