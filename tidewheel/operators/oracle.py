"""Named CTEs of the reference SQL; with_() adds what a statement uses, in order."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
#: Used in many places of a statement: computed once.
SHARED = ("x_prices", "x_bars", "x_dates", "x_eff", "x_members", "x_sectors", "x_industries", "x_stocks", "x_catalysts", "x_top", "x_watch_days", "x_watch_a", "x_watch_b", "x_watch_c", "x_macro_asof", "x_flags", "x_action", "x_ibars", "x_mansfield", "x_sheld", "x_sstage1", "x_sbars")


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def with_(final: str) -> str:
    needed: dict[str, None] = {}

    def visit(sql: str) -> None:
        for name in re.findall(r"\b[a-z]\w+\b", sql):
            if name in CTES and name not in needed:
                visit(CTES[name])
                needed[name] = None

    visit(final)
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in SHARED else ''}({CTES[n]})" for n in needed) + "\n" + final if needed else final
