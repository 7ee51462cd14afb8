"""Queries and oracle SQL of the market operators, assembled from their modules."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = (
    "sources.adapter",
    "sources.tables",
    "sources.provider",
    "operators.features",
    "operators.merge",
    "operators.schema",
    "plans.scores",
    "plans.labels",
    "plans.backtest",
    "plans.intraday",
    "plans.sessions",
    "plans.screener",
    "plans.runs",
    "plans.quality",
    "plans.report",
)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"tidewheel.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in getattr(import_module(f"tidewheel.{m}"), "ORACLE", {}).items()}
