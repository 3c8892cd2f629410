"""All queries of the engine's own operators, with their oracles."""

from __future__ import annotations

from . import cases, fixtures, stages, tables


def queries() -> dict:
    return tables.QUERIES | stages.QUERIES | fixtures.QUERIES | cases.QUERIES


def oracle_sql() -> dict[str, str]:
    return tables.ORACLES | stages.ORACLES | fixtures.ORACLES | cases.ORACLES
