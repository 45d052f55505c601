"""The registered queries of the asset engine, collected from the plan modules."""

from __future__ import annotations

from tidemark.plans import bars, derive, fixtures, runs, sources  # noqa: F401  plans register themselves

QUERIES = fixtures.QUERIES
ORACLE_SQL = fixtures.ORACLE_SQL
