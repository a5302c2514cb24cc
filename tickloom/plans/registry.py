"""All queries on the test tables with their SQL counterparts."""

from __future__ import annotations

from tickloom.plans import feeds, ingest, prices, reports, series, serving

MODULES = (prices, feeds, serving, reports, series, ingest)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
