"""Per-bar indicators: every one a window over a symbol's bars in date order.

All of them share one partitioning and one sort. A lookback counts bars, not
days; an indicator without enough bars is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel import config as C
from tidewheel.functions.expressions import distance, over, r6, ratio
from tidewheel.operators.oracle import cte, with_
from tidewheel.operators.store import stored
from tidewheel.sources.adapter import fund_prices, stock_prices

#: First what only needs the prices, then what needs those columns.
BASE = {
    "bar_idx": "CAST(" + over("row_number()") + " - 1 AS INT)",
    "prev_close": over("lag(close, 1)"),
    "prev_ac": over("lag(ac, 1)"),
    "rv_base": over("avg(volume)", 20, -1),
    "adv_base": over("avg(ac * volume)", 19),
    "ma20_": over("avg(ac)", 19),
    "ma50_": over("avg(ac)", 49),
    "high20_": over("max(ac)", 19),
    "high60_": over("max(ac)", 59),
    "high10_": over("max(ac)", 9),
    "low10_": over("min(ac)", 9),
    "adr20_": over("avg(CASE WHEN close <> 0 THEN (high - low) / close END)", 19),
    "next_date": over("lead(date, 1)"),
    **{f"ac_{n}": over(f"lag(ac, {n})") for n in (1, 5, 20, 60)},
    **{f"ac_ahead_{h}": over(f"lead(ac, {h})") for h in C.HORIZONS},
}
RANGES = {
    "tr": "greatest(high - low, abs(high - prev_close), abs(low - prev_close))",
    "tr_adj": "greatest(high - low, abs(high - coalesce(prev_ac, ac)), abs(low - coalesce(prev_ac, ac)))",
}
MEANS = {"atr14_": over("avg(tr)", 13), "atr20_": over("avg(tr_adj)", 19)}


#: Bars before a bar that any of its measures needs.
LOOKBACK = 60

#: What is summed or compared over the last bars.
SUMMED = {"volume": "volume", "traded": "ac * volume", "ac": "ac", "range": "CASE WHEN close <> 0 THEN (high - low) / close END", "tr": "tr", "tr_adj": "tr_adj"}
#: Bars of a piece: a frame of n bars is made of the pieces that end 0, 10, 20, .. bars ago, so a bar is met n / 10 times for it and not n times.
PIECE = 10
#: Bars of a piece of ranges, whose mean is one of 14 bars.
RANGE_PIECE = 7


def sums(name: str, x: str, piece: int = PIECE) -> dict[str, str]:
    return {f"{name}_sum": over(f"sum({x})", piece - 1), f"{name}_n": over(f"count({x})", piece - 1)}


def earlier(columns: list[str], offsets: list[int]) -> dict[str, str]:
    """The columns as they were some bars ago, named by how many."""
    return {f"{c}_{o}": over(f"lag({c}, {o})") for c in columns for o in offsets if o}


def ends(n: int, shift: int = 0, piece: int = PIECE) -> list[int]:
    return list(range(shift, n + shift, piece))


def pieces(column: str, at: list[int]) -> list[str]:
    return [f"{column}_{o}" if o else column for o in at]


def mean(name: str, at: list[int]) -> str:
    """The mean of what is not null in the pieces that ended so many bars ago, as avg has it."""
    total = lambda c: "(" + " + ".join(f"coalesce({x}, 0)" for x in pieces(c, at)) + ")"
    return f"{total(f'{name}_sum')} / nullif({total(f'{name}_n')}, 0)"


def back(name: str, n: int) -> dict[str, str]:
    """What is summed, as it was 1, 2, .. n bars ago."""
    return {f"{name}_{k}": over(f"lag({SUMMED[name]}, {k})") for k in range(1, n + 1)}


def mean_in_order(name: str, piece: int = PIECE) -> str:
    """The mean of the bars of two pieces, summed from the oldest on: the older piece, then bar by bar.

    Fractions are summed as avg over the whole frame has them. A close that is
    exactly its own mean is above it or not by the last bit of the sum.
    """
    ago = [f"{name}_{k}" for k in range(piece - 1, 0, -1)] + [f"({SUMMED[name]})"]
    total = " + ".join(f"coalesce({x}, 0)" for x in [f"{name}_sum_{piece}", *ago])
    counted = " + ".join(f"coalesce({x}, 0)" for x in pieces(f"{name}_n", ends(2 * piece, piece=piece)))
    return f"({total}) / nullif({counted}, 0)"


#: BASE and MEANS in three passes over the same sort: pieces and single bars, pieces some bars ago (and those of ranges), pieces of ranges some bars ago.
FIRST = (
    {k: x for k, x in BASE.items() if " ROWS " not in x}
    | {c: x for k in ("volume", "traded", "ac", "range") for c, x in sums(k, SUMMED[k]).items()}
    | {c: x for k in ("traded", "ac", "range") for c, x in back(k, PIECE - 1).items()}
    | {"ac_max": over("max(ac)", PIECE - 1), "ac_min": over("min(ac)", PIECE - 1)}
)
SECOND = (
    earlier(["volume_sum", "volume_n"], ends(20, 1))
    | earlier(["traded_sum", "traded_n", "range_sum", "range_n"], ends(20))
    | earlier(["ac_sum", "ac_n"], ends(50))
    | earlier(["ac_max"], ends(60))
    | sums("tr", "tr", RANGE_PIECE)
    | sums("tr_adj", "tr_adj")
    | back("tr", RANGE_PIECE - 1)
    | back("tr_adj", PIECE - 1)
)
THIRD = earlier(["tr_sum", "tr_n"], ends(14, piece=RANGE_PIECE)) | earlier(["tr_adj_sum", "tr_adj_n"], ends(20))
#: The frames of BASE and MEANS where they are whole; FINAL asks for no others. Volumes are whole numbers, whose sums are the same in any order; 50 closes are not added in order, which the SQL's engine doesn't do for so many, either.
FRAMES = {
    "rv_base": mean("volume", ends(20, 1)),
    "adv_base": mean_in_order("traded"),
    "ma20_": mean_in_order("ac"),
    "ma50_": mean("ac", ends(50)),
    "high20_": f"greatest({', '.join(pieces('ac_max', ends(20)))})",
    "high60_": f"greatest({', '.join(pieces('ac_max', ends(60)))})",
    "high10_": "ac_max",
    "low10_": "ac_min",
    "adr20_": mean_in_order("range"),
    "atr14_": mean_in_order("tr", RANGE_PIECE),
    "atr20_": mean_in_order("tr_adj"),
}


def after(n: int, x: str) -> str:
    return f"CASE WHEN bar_idx >= {n} THEN {x} END"


FINAL = {
    **{f"r{n}": after(n, distance("ac", f"ac_{n}")) for n in (1, 5, 20, 60)},
    **{f"fwd{h}": distance(f"ac_ahead_{h}", "ac") for h in C.HORIZONS},
    "rv20": after(20, ratio("volume", "rv_base")),
    "adv20": after(20, "adv_base"),
    "ma20": after(19, "ma20_"),
    "ma50": after(49, "ma50_"),
    "high20": after(19, "high20_"),
    "high60": after(59, "high60_"),
    "high10": after(9, "high10_"),
    "low10": after(9, "low10_"),
    "atr14": after(13, "atr14_"),
    "atr20": after(19, "atr20_"),
    "adr20": after(19, "adr20_"),
    "gap": distance("open", "prev_close"),
    "above20": f"coalesce(ac > {after(19, 'ma20_')}, false)",
    "above50": f"coalesce(ac > {after(49, 'ma50_')}, false)",
    "at_high20": f"coalesce(ac >= {after(19, 'high20_')}, false)",
}
TREND = "CASE WHEN above20 AND above50 THEN 'above_20d_50d' WHEN above20 THEN 'above_20d' ELSE 'below_trend' END"
CARRIED = ["symbol", "date", "open", "high", "low", "close", "ac", "volume", "bar_idx", "tr", "next_date"]


def recent_prices(prices: DataFrame, since: DataFrame) -> DataFrame:
    """prices with bar_idx, without those that no measure of a bar in effect from `since` (one row) on looks back to."""
    numbered = prices.selectExpr("*", f"{BASE['bar_idx']} AS bar_idx").crossJoin(F.broadcast(since))  # one row
    last = "max(CASE WHEN date <= since THEN bar_idx END) OVER (PARTITION BY symbol)"
    return numbered.withColumn("in_effect", F.expr(f"coalesce({last}, 0)")).filter(F.col("bar_idx") >= F.col("in_effect") - LOOKBACK).drop("since", "in_effect")


def bars(prices: DataFrame) -> DataFrame:
    """prices with every indicator; those that are only a symbol's last ones have their bar_idx."""
    name = lambda d: [f"{x} AS {k}" for k, x in d.items()]
    first = {k: x for k, x in FIRST.items() if k not in prices.columns}
    out = prices.select(*(c for c in CARRIED if c in prices.columns)).selectExpr("*", *name(first))
    out = out.selectExpr("*", *name(RANGES)).selectExpr("*", *name(SECOND)).selectExpr("*", *name(THIRD)).selectExpr("*", *name(FRAMES))
    return out.selectExpr(*CARRIED, *name(FINAL)).selectExpr("*", f"{TREND} AS trend_state")


def all_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stock_bars(spark, sf_dir).unionByName(etf_bars(spark, sf_dir))


def stock_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks' bars, made anew by each plan, with the columns it needs, where their lines are stored."""
    return bars(stock_prices(spark, sf_dir))


def etf_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "etf_bars", lambda: bars(fund_prices(spark, sf_dir)))


def _text(d: dict[str, str]) -> str:
    return ", ".join(f"{x} AS {k}" for k, x in d.items())


cte("x_bars1", f"SELECT symbol, date, open, high, low, close, ac, volume, {_text(BASE)} FROM x_prices")
cte("x_bars2", f"SELECT *, {_text(RANGES)} FROM x_bars1")
cte("x_bars3", f"SELECT *, {_text(MEANS)} FROM x_bars2")
cte("x_bars4", f"SELECT {', '.join(CARRIED)}, {_text(FINAL)} FROM x_bars3")
cte("x_bars", f"SELECT *, {TREND} AS trend_state FROM x_bars4")

_KEYS = ["symbol", "date", "bar_idx"]
_SETS = {
    "w01_returns": [r6(f"coalesce(r{n}, 0.0)", f"r{n}") for n in (1, 5, 20, 60)],
    "w02_forward_returns": [r6(f"coalesce(fwd{h}, -9.0)", f"fwd{h}") for h in C.HORIZONS],
    "w03_relative_volume": [r6("coalesce(rv20, 1.0)", "rv20")],
    "w04_dollar_volume": [r6("coalesce(adv20, 0.0) / 1e4", "adv20")],
    "w05_moving_averages": [r6("coalesce(ma20, 0.0)", "ma20"), r6("coalesce(ma50, 0.0)", "ma50")],
    "w06_high_low": [r6(f"coalesce({c}, 0.0)", c) for c in ("high20", "high60", "high10", "low10")],
    "w07_true_range": [r6("tr")],
    "w08_atr14": [r6("coalesce(atr14, 0.0)", "atr14")],
    "w09_gap": [r6("coalesce(gap, 0.0)", "gap")],
    "w10_trend_state": ["trend_state"],
    "w11_high_flag": ["at_high20"],
    "w12_adr": [r6("coalesce(adr20, 0.0)", "adr20")],
    "w15_atr20": [r6("coalesce(atr20, 0.0)", "atr20")],
}
QUERIES = {k: (lambda spark, d, x=x: all_bars(spark, d).selectExpr(*_KEYS, *x)) for k, x in _SETS.items()}
ORACLE = {k: with_(f"SELECT {', '.join(_KEYS + x)} FROM x_bars") for k, x in _SETS.items()}
