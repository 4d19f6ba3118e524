"""Registry of the contract queries."""

from __future__ import annotations

from girder.plans.contract import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
