"""All registered queries and their oracle SQL."""

from __future__ import annotations

from . import catalog_core, catalog_ops, catalog_sources, catalog_text, oracle_audit, oracle_core, oracle_ops, oracle_text


def queries() -> dict:
    return catalog_core.queries() | catalog_ops.queries() | catalog_text.queries() | catalog_sources.queries()


def oracle_sql() -> dict:
    found = oracle_core.oracles() | oracle_ops.oracles() | oracle_text.oracles() | oracle_audit.oracles() | catalog_sources.oracles()
    return {k: v for k, v in found.items() if k in queries()}
