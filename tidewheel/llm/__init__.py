"""Corpus preparation for language models: thirteen operators, each its own module.

Nothing outside this subpackage imports it. queries() and oracle_sql() hold
what the repository's entry file registers.
"""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "perspectives",
    "language",
    "decontaminate",
    "kneser_ney",
    "bpe",
    "bagminhash",
    "secrets",
    "quality",
    "rans",
    "rollup",
    "prefixes",
    "threshold",
    "simhash",
)


_LOADED = [import_module(f"{__name__}.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _LOADED for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in _LOADED for k, q in getattr(m, "ORACLE", {}).items()}
