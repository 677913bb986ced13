"""Queries over the driver's tables and SQL for the same results."""

from __future__ import annotations


def _modules() -> list:
    from ledgerwell.plans import accounts, bronze, companies, exchange, feeds, household, markets, messages, portfolio, positions, streams, texts

    return [portfolio, household, markets, positions, texts, streams, exchange, companies, bronze, feeds, messages, accounts]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _modules() for k, v in m.ORACLE_SQL.items()}
