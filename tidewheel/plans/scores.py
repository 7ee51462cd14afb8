"""Market regime, sector, industry and stock scores of every date at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel import config as C
from tidewheel.functions.expressions import clamp, distance, r6, rank_key, rel_score, volume_score
from tidewheel.operators.asof import effective, score_dates
from tidewheel.operators.features import all_bars, bars, etf_bars, stock_bars
from tidewheel.operators.oracle import cte, with_
from tidewheel.operators.store import stored
from tidewheel.sources.adapter import sector_map, stock_prices, symbols

# ---- shared formulas ------------------------------------------------------------

REGIME_INPUTS = {
    "spy20": "coalesce(max(CASE WHEN symbol = 'SPY' THEN r20 END), 0.0)",
    "spy60": "coalesce(max(CASE WHEN symbol = 'SPY' THEN r60 END), 0.0)",
    **{k.lower(): f"max(CASE WHEN symbol = '{x}' THEN r20 END)" for k, x in C.PROXIES.items()},
}
REGIME_RELATIVE = {"qqq_rel": "coalesce(qqq - spy20, 0.0)", "iwm_rel": "coalesce(iwm - spy20, 0.0)", "dia_rel": "coalesce(dia - spy20, 0.0)", "tlt20": "coalesce(tlt, 0.0)", "gld20": "coalesce(gld, 0.0)", "uso20": "coalesce(uso, 0.0)"}
REGIME_SCORE = f"0.40 * {clamp(f'{C.NEUTRAL} + {C.TREND_SCALE} * spy20 + {C.TREND_SCALE} * 0.40 * spy60')} + 0.25 * {rel_score('qqq_rel')} + 0.25 * {rel_score('iwm_rel')} + 0.10 * {rel_score('dia_rel')}"
REGIME_BASE = "CASE WHEN score >= 60 AND spy20 >= 0 AND (qqq_rel >= 0 OR iwm_rel >= 0) THEN 'Risk-on' WHEN score <= 40 AND spy20 < 0 AND spy60 < 0 THEN 'Risk-off' WHEN spy20 >= 0 AND qqq_rel < 0 AND iwm_rel < 0 THEN 'Defensive' ELSE 'Mixed' END"
REGIME_CONTEXT = "CASE WHEN gld20 >= 0.03 AND uso20 >= 0.03 THEN 'Inflation-sensitive' WHEN tlt20 <= -0.03 THEN 'Rate-sensitive' WHEN spy20 < 0 AND tlt20 >= 0.03 THEN 'Defensive bid' ELSE '' END"
REGIME_LABEL = "CASE WHEN context = '' THEN base_label ELSE concat(base_label, ' / ', context) END"

SECTOR_PARTS = {
    "rel_spy": "r20 - spy20",
    "breadth": "(breadth_20d + breadth_50d) / 2.0",
}
SECTOR_SCORE = f"(0.30 * {rel_score('rel_spy')} + 0.20 * {clamp(f'{C.NEUTRAL} + {C.TREND_SCALE} * r20')} + 0.20 * {volume_score('rel_volume')} + 0.20 * breadth) / 0.90"
INDUSTRY_SCORE = f"0.30 * {rel_score('rel_sector')} + 0.20 * {rel_score('rel_spy')} + 0.20 * (breadth_20d + breadth_50d) / 2.0 + 0.15 * {volume_score('rel_volume')} + 0.15 * high_20d_rate"
TREND_SCORE = "CASE trend_state WHEN 'above_20d_50d' THEN 90.0 WHEN 'above_20d' THEN 70.0 WHEN 'below_trend' THEN 35.0 ELSE 50.0 END"
STOCK_SCORE = f"0.30 * sector_score + 0.25 * {rel_score('rel_sector')} + 0.20 * {volume_score('rel_volume')} + 0.15 * {TREND_SCORE} + 0.10 * {clamp(f'avg_dollar_volume / {C.MIN_DOLLAR_VOLUME} * {C.LIQUIDITY_SCALE}')}"

#: Price-structure measures of a stock; null unless all their inputs are there.
METRICS = {
    "complete": "bar_idx >= 59 AND ma20 <> 0 AND ma50 <> 0 AND close <> 0 AND high20 <> 0 AND high60 <> 0 AND ac <> 0",
    "dist20": distance("ac", "ma20"),
    "dist50": distance("ac", "ma50"),
    "atr_pct": distance("close + atr14", "close"),
    "atr_ext20": "CASE WHEN atr14 = 0 THEN 0.0 ELSE (ac - ma20) / nullif(atr14, 0) END",
    "atr_ext50": "CASE WHEN atr14 = 0 THEN 0.0 ELSE (ac - ma50) / nullif(atr14, 0) END",
    "dist20high": distance("ac", "high20"),
    "dist60high": distance("ac", "high60"),
    "range10": "(high10 - low10) / nullif(ac, 0)",
    "gap0": "coalesce(gap, 0.0)",
    "tr_pct": distance("close + tr", "close"),
}
CARRY = ["r1", "r5", "r20", "r60"]
#: A step of the ranking key, a quarter of a point.
SCORE_STEP = 25_000_000
#: The stocks of one in so many symbols' hashes bound the step from which a day's stocks are sorted.
BOUND_BY = 16


def named(d: dict[str, str]) -> list[str]:
    return [f"{x} AS {k}" for k, x in d.items()]


def text(d: dict[str, str]) -> str:
    return ", ".join(named(d))


# ---- DataFrames -----------------------------------------------------------------


class Market:
    """Tables of one folder that several plans share.

    Scores and the bars of funds are stored at their first use, so no plan holds
    another one twice. Stocks' bars are made of their stored lines by each plan, in
    place and with the columns it needs; bars in effect are counted or filtered as
    they are made and never shuffled or written.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, bars: DataFrame | None = None, members: DataFrame | None = None, funds: DataFrame | None = None):
        self.spark, self.sf_dir = spark, sf_dir
        self._keep = bars is None and members is None and funds is None
        self._bars = bars
        self.symbols = symbols(spark, sf_dir) if members is None else members
        self.funds = sector_map(spark, sf_dir) if funds is None else funds
        self.stocks = self.symbols.filter("asset_type = 'stock'").select("symbol", "name", "sector", "industry")

    @cached_property
    def bars(self) -> DataFrame:
        return all_bars(self.spark, self.sf_dir) if self._bars is None else self._bars

    @cached_property
    def stock_bars(self) -> DataFrame:
        """Bars among which those of all stocks are."""
        return stock_bars(self.spark, self.sf_dir) if self._keep else self.bars

    def bars_of(self, some: DataFrame) -> DataFrame:
        """Stocks' bars of some symbols; of kept tables others get no windows."""
        only = lambda df: df.join(F.broadcast(some), "symbol", "left_semi")  # noqa: E731  at most STORED_STOCKS for each date
        return bars(only(stock_prices(self.spark, self.sf_dir))) if self._keep else only(self.bars)

    @cached_property
    def etfs(self) -> DataFrame:
        """Bars among which those of the benchmark, the funds and the proxies are."""
        return etf_bars(self.spark, self.sf_dir) if self._keep else self.bars

    @cached_property
    def dates(self) -> DataFrame:
        return self.table("score_dates", lambda: score_dates(self.etfs))

    @cached_property
    def eff(self) -> DataFrame:
        return effective(self.bars, self.dates)

    @cached_property
    def etf_eff(self) -> DataFrame:
        return self.table("etf_effective", lambda: effective(self.etfs, self.dates))

    @cached_property
    def spy(self) -> DataFrame:
        return self.etf_eff.filter("symbol = 'SPY'").selectExpr("score_date", "coalesce(r20, 0.0) AS spy20")

    def table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A stored table of the folder; tables given by the caller are planned through."""
        return stored(self.spark, self.sf_dir, name, build) if self._keep else build()

    def regime(self) -> DataFrame:
        """One row a date: inputs, score, base_label, context, label."""
        wide = self.etf_eff.filter(F.col("symbol").isin("SPY", *C.PROXIES.values())).groupBy("score_date").agg(*(F.expr(x).alias(k) for k, x in REGIME_INPUTS.items()))
        out = wide.selectExpr("score_date", "spy20", "spy60", *named(REGIME_RELATIVE)).withColumn("score", F.expr(REGIME_SCORE))
        return out.withColumn("base_label", F.expr(REGIME_BASE)).withColumn("context", F.expr(REGIME_CONTEXT)).withColumn("label", F.expr(REGIME_LABEL))

    def member_bars(self, which: str = "true") -> DataFrame:
        """Stocks' bars in effect with their sector and industry, of the symbols told by `which`."""
        return effective(self.stock_bars.filter(which).join(self.stocks, "symbol"), self.dates)

    def groups(self) -> DataFrame:
        """Counts and sums of stocks by date, sector and industry."""
        return self.table("groups", self._groups)

    def _groups(self) -> DataFrame:
        counts = [F.count_if(c).alias(f"n_{c}") for c in ("above20", "above50", "at_high20")]
        sums = [x for c in ("r5", "r20", "r60", "rv20") for x in (F.sum(c).alias(f"sum_{c}"), F.count(c).alias(f"n_{c}"))]
        return self.member_bars().groupBy("score_date", "sector", "industry").agg(F.count(F.lit(1)).alias("n"), *counts, *sums)

    def breadth(self, *by: str) -> DataFrame:
        share = lambda c, n: F.expr(f"100.0D * (sum(n_{c}) / sum(n))").alias(n)
        mean = lambda c, n: F.expr(f"sum(sum_{c}) / nullif(sum(n_{c}), 0)").alias(n)
        return self.groups().groupBy("score_date", *by).agg(share("above20", "breadth_20d"), share("above50", "breadth_50d"), share("at_high20", "high_20d_rate"), F.sum("n").alias("valid_members"), mean("r5", "m5"), mean("r20", "m20"), mean("r60", "m60"), mean("rv20", "mrv"))

    def fund_bars(self) -> DataFrame:
        """(score_date, sector, sector_etf, r1..r60, rel_volume, spy20) of every sector and date; a fund without bars counts as flat."""
        spine = self.dates.crossJoin(F.broadcast(self.funds))  # dates by sectors: the result's own rows
        fund = self.etf_eff.select("score_date", F.col("symbol").alias("sector_etf"), *CARRY, "rv20")
        zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in CARRY]
        return spine.join(fund, ["score_date", "sector_etf"], "left").join(self.spy, "score_date").select("score_date", "sector", "sector_etf", *zero, F.coalesce("rv20", F.lit(1.0)).alias("rel_volume"), "spy20")

    def sectors(self) -> DataFrame:
        return self.table("sectors", self._sectors)

    def _sectors(self) -> DataFrame:
        joined = self.fund_bars().join(self.breadth("sector").select("score_date", "sector", "breadth_20d", "breadth_50d"), ["score_date", "sector"], "left").na.fill(0.0, ["breadth_20d", "breadth_50d"])
        scored = joined.selectExpr("*", *named(SECTOR_PARTS)).withColumn("score", F.expr(SECTOR_SCORE))
        ranked = scored.withColumn("rank", F.expr(f"CAST(row_number() OVER (PARTITION BY score_date ORDER BY {rank_key('score')} DESC, sector) AS INT)"))
        return ranked.withColumn("rank_change", F.expr("coalesce(CAST(lag(rank, 1) OVER (PARTITION BY sector ORDER BY score_date) - rank AS DOUBLE), 0.0)"))

    def industries(self) -> DataFrame:
        return self.table("industries", self._industries)

    def _industries(self) -> DataFrame:
        grouped = self.stocks.filter("sector IS NOT NULL AND industry IS NOT NULL").groupBy("sector", "industry").agg(F.count(F.lit(1)).alias("member_count"))
        spine = self.fund_bars().selectExpr("score_date", "sector", "r20 AS sector_r20", "spy20").join(grouped, "sector")
        seen = self.breadth("sector", "industry")
        zero = lambda a, b: f"coalesce({a}, 0.0) AS {b}"
        out = spine.join(seen, ["score_date", "sector", "industry"], "left").selectExpr(
            "score_date", "sector", "industry", "member_count", "coalesce(valid_members, 0) AS valid_members", zero("m5", "return_5d"), zero("m20", "return_20d"), zero("m60", "return_60d"), "coalesce(m20, 0.0) - sector_r20 AS rel_sector", "coalesce(m20, 0.0) - spy20 AS rel_spy", "coalesce(mrv, 1.0) AS rel_volume", zero("breadth_20d", "breadth_20d"), zero("breadth_50d", "breadth_50d"), zero("high_20d_rate", "high_20d_rate")
        )
        return out.withColumn("score", F.expr(INDUSTRY_SCORE)).withColumn("rank", F.expr(f"CAST(row_number() OVER (PARTITION BY score_date ORDER BY {rank_key('score')} DESC, sector, industry) AS INT)"))

    def stock_scores(self) -> DataFrame:
        return self.table("stock_scores", self._stock_scores)

    def _scored(self, which: str = "true") -> DataFrame:
        """Every liquid stock on every date with its score, the key it is ranked by and the step of that key; of the symbols told by `which`."""
        fund = self.sectors().selectExpr("score_date", "sector", "r20 AS sector_r20", "spy20", "score AS sector_score")
        rows = self.member_bars(which).filter("sector IS NOT NULL AND industry IS NOT NULL").filter(F.coalesce("adv20", F.lit(0.0)) >= C.MIN_DOLLAR_VOLUME)
        rows = rows.selectExpr("score_date", "symbol", "name", "sector", "industry", "date AS bar_date", "coalesce(r20, 0.0) AS r20", "coalesce(rv20, 1.0) AS rel_volume", "coalesce(adv20, 0.0) AS avg_dollar_volume", "trend_state")
        joined = rows.join(F.broadcast(fund), ["score_date", "sector"], "left").withColumn("sector_score", F.coalesce("sector_score", F.lit(C.NEUTRAL))).na.fill(0.0, ["sector_r20", "spy20"]).selectExpr("*", "r20 - sector_r20 AS rel_sector", "r20 - spy20 AS rel_spy").withColumn("score", F.expr(STOCK_SCORE))  # fund: a row for each date and sector
        return joined.withColumn("step", F.expr(f"coalesce(floor({rank_key('score')} / {SCORE_STEP}), -1)"))

    def _floors(self) -> DataFrame:
        """(score_date, least): a step that at least STORED_STOCKS stocks reach, so no stored stock lies below it.

        The stocks of some symbols are counted: as many of them reach the step, so as
        many or more of all do. A date on which they are too few has no bound.
        """
        counts = self._scored(f"pmod(xxhash64(symbol), {BOUND_BY}) = 0").groupBy("score_date", "step").agg(F.count(F.lit(1)).alias("n"))
        reached = counts.selectExpr("score_date", "step", "sum(n) OVER (PARTITION BY score_date ORDER BY step DESC) AS reached")
        return reached.filter(F.col("reached") >= C.STORED_STOCKS).groupBy("score_date").agg(F.max("step").alias("least"))

    def _ranks(self) -> DataFrame:
        """The best STORED_STOCKS liquid stocks of every date, out of all; only those from the date's bound up are sorted."""
        floors = self.table("stock_floors", self._floors)
        best = self._scored().join(F.broadcast(floors), "score_date", "left").filter("least IS NULL OR step >= least").drop("step", "least")  # a row for each date
        return best.withColumn("rank", F.expr(f"CAST(row_number() OVER (PARTITION BY score_date ORDER BY {rank_key('score')} DESC, symbol) AS INT)")).filter(F.col("rank") <= C.STORED_STOCKS)

    def _stock_scores(self) -> DataFrame:
        """The stored stocks of every date with their price-structure measures, the bar's day and its forward returns."""
        ranks = self.table("stock_ranks", self._ranks)
        zero = [f"coalesce({c}, 0.0) AS {c}" for c in CARRY if c != "r20"]
        own = self.bars_of(ranks.select("symbol").distinct()).selectExpr("symbol", "date AS bar_date", *zero, *named(METRICS), *(f"fwd{h}" for h in C.HORIZONS))
        return own.join(F.broadcast(ranks), ["symbol", "bar_date"])  # STORED_STOCKS rows for each date at most


# ---- reference SQL --------------------------------------------------------------

cte("x_spy", "SELECT score_date, coalesce(r20, 0.0) AS spy20 FROM x_eff WHERE symbol = 'SPY'")
cte("x_regime1", f"SELECT score_date, {text(REGIME_INPUTS)} FROM x_eff GROUP BY score_date")
cte("x_regime2", f"SELECT score_date, spy20, spy60, {text(REGIME_RELATIVE)} FROM x_regime1")
cte("x_regime3", f"SELECT *, {REGIME_SCORE} AS score FROM x_regime2")
cte("x_regime4", f"SELECT *, {REGIME_BASE} AS base_label, {REGIME_CONTEXT} AS context FROM x_regime3")
cte("x_regime", f"SELECT *, {REGIME_LABEL} AS label FROM x_regime4")
cte("x_members", "SELECT e.*, s.name, s.sector, s.industry FROM x_eff e JOIN x_symbols s ON e.symbol = s.symbol WHERE s.asset_type = 'stock'")
for _name, _by in (("x_breadth_sector", "sector"), ("x_breadth_industry", "sector, industry")):
    cte(_name, f"SELECT score_date, {_by}, 100.0 * count(*) FILTER (WHERE above20) / count(*) AS breadth_20d, 100.0 * count(*) FILTER (WHERE above50) / count(*) AS breadth_50d, 100.0 * count(*) FILTER (WHERE at_high20) / count(*) AS high_20d_rate, count(*) AS valid_members, avg(r5) AS m5, avg(r20) AS m20, avg(r60) AS m60, avg(rv20) AS mrv FROM x_members GROUP BY score_date, {_by}")
cte("x_funds", "SELECT d.score_date, m.sector, m.sector_etf, coalesce(e.r1, 0.0) AS r1, coalesce(e.r5, 0.0) AS r5, coalesce(e.r20, 0.0) AS r20, coalesce(e.r60, 0.0) AS r60, coalesce(e.rv20, 1.0) AS rel_volume, s.spy20 FROM x_dates d CROSS JOIN x_sector_map m LEFT JOIN x_eff e ON e.score_date = d.score_date AND e.symbol = m.sector_etf JOIN x_spy s ON s.score_date = d.score_date")
cte("x_sectors1", f"SELECT f.*, coalesce(b.breadth_20d, 0.0) AS breadth_20d, coalesce(b.breadth_50d, 0.0) AS breadth_50d FROM x_funds f LEFT JOIN x_breadth_sector b USING (score_date, sector)")
cte("x_sectors2", f"SELECT *, {text(SECTOR_PARTS)} FROM x_sectors1")
cte("x_sectors3", f"SELECT *, {SECTOR_SCORE} AS score FROM x_sectors2")
cte("x_sectors4", f"SELECT *, CAST(row_number() OVER (PARTITION BY score_date ORDER BY {rank_key('score')} DESC, sector) AS INT) AS rank FROM x_sectors3")
cte("x_sectors", "SELECT *, coalesce(CAST(lag(rank, 1) OVER (PARTITION BY sector ORDER BY score_date) - rank AS DOUBLE), 0.0) AS rank_change FROM x_sectors4")
cte("x_industries1", "SELECT f.score_date, f.sector, g.industry, g.member_count, coalesce(b.valid_members, 0) AS valid_members, coalesce(m5, 0.0) AS return_5d, coalesce(m20, 0.0) AS return_20d, coalesce(m60, 0.0) AS return_60d, coalesce(m20, 0.0) - f.r20 AS rel_sector, coalesce(m20, 0.0) - f.spy20 AS rel_spy, coalesce(mrv, 1.0) AS rel_volume, coalesce(breadth_20d, 0.0) AS breadth_20d, coalesce(breadth_50d, 0.0) AS breadth_50d, coalesce(high_20d_rate, 0.0) AS high_20d_rate FROM x_funds f JOIN (SELECT sector, industry, count(*) AS member_count FROM x_symbols WHERE asset_type = 'stock' AND sector IS NOT NULL AND industry IS NOT NULL GROUP BY sector, industry) g ON f.sector = g.sector LEFT JOIN x_breadth_industry b ON b.score_date = f.score_date AND b.sector = g.sector AND b.industry = g.industry")
cte("x_industries2", f"SELECT *, {INDUSTRY_SCORE} AS score FROM x_industries1")
cte("x_industries", f"SELECT *, CAST(row_number() OVER (PARTITION BY score_date ORDER BY {rank_key('score')} DESC, sector, industry) AS INT) AS rank FROM x_industries2")
cte("x_stocks1", f"SELECT m.score_date, symbol, name, m.sector, industry, {', '.join(f'coalesce(m.{c}, 0.0) AS {c}' for c in CARRY)}, coalesce(rv20, 1.0) AS rel_volume, coalesce(adv20, 0.0) AS avg_dollar_volume, trend_state, {text(METRICS)}, coalesce(s.r20, 0.0) AS sector_r20, coalesce(s.spy20, 0.0) AS spy20, coalesce(s.score, {C.NEUTRAL}) AS sector_score FROM x_members m LEFT JOIN x_sectors s ON s.score_date = m.score_date AND s.sector = m.sector WHERE m.sector IS NOT NULL AND industry IS NOT NULL AND coalesce(adv20, 0.0) >= {C.MIN_DOLLAR_VOLUME}")
cte("x_stocks2", "SELECT *, r20 - sector_r20 AS rel_sector, r20 - spy20 AS rel_spy FROM x_stocks1")
cte("x_stocks3", f"SELECT *, {STOCK_SCORE} AS score FROM x_stocks2")
cte("x_stocks4", f"SELECT *, CAST(row_number() OVER (PARTITION BY score_date ORDER BY {rank_key('score')} DESC, symbol) AS INT) AS rank FROM x_stocks3")
cte("x_stocks", f"SELECT * FROM x_stocks4 WHERE rank <= {C.STORED_STOCKS}")

# ---- queries --------------------------------------------------------------------

_OUT = {
    "j01_asof_bars": (lambda m: m.eff, "x_eff", ["score_date", "symbol", "date", r6("coalesce(r20, -9.0)", "r20")]),
    "q01_regime": (lambda m: m.regime(), "x_regime", ["score_date", "label", "base_label", "context", *(r6(c) for c in ("score", "spy20", "spy60", "qqq_rel", "iwm_rel", "dia_rel"))]),
    "a02_sector_breadth": (lambda m: m.breadth("sector"), "x_breadth_sector", ["score_date", "sector", "valid_members", r6("breadth_20d"), r6("breadth_50d"), r6("high_20d_rate")]),
    "a03_industry_means": (lambda m: m.breadth("sector", "industry"), "x_breadth_industry", ["score_date", "sector", "industry", r6("coalesce(m5, -9.0)", "m5"), r6("coalesce(m20, -9.0)", "m20"), r6("coalesce(m60, -9.0)", "m60"), r6("coalesce(mrv, -9.0)", "mrv")]),
    "a04_industry_participation": (lambda m: m.industries(), "x_industries", ["score_date", "sector", "industry", "member_count", "valid_members", r6("breadth_20d"), r6("breadth_50d"), r6("high_20d_rate")]),
    "q04_sector_scores": (lambda m: m.sectors(), "x_sectors", ["score_date", "sector", "sector_etf", "rank", "rank_change", *(r6(c) for c in ("score", "r1", "r5", "r20", "r60", "rel_spy", "rel_volume", "breadth_20d", "breadth_50d"))]),
    "q05_industry_scores": (lambda m: m.industries(), "x_industries", ["score_date", "sector", "industry", "rank", *(r6(c) for c in ("score", "return_5d", "return_20d", "return_60d", "rel_sector", "rel_spy", "rel_volume"))]),
    "q06_stock_scores": (lambda m: m.stock_scores(), "x_stocks", ["score_date", "symbol", "sector", "industry", "rank", "trend_state", *(r6(c) for c in ("score", "sector_score", "r1", "r5", "r20", "r60", "rel_sector", "rel_spy", "rel_volume"))]),
    "q09_stock_metrics": (lambda m: m.stock_scores(), "x_stocks", ["score_date", "symbol", "complete", *(r6(f"coalesce({c}, -9.0)", c) for c in METRICS if c != "complete")]),
    "r02_watchlist": (lambda m: m.stock_scores().filter(f"rank <= {C.WATCHLIST}"), "(SELECT * FROM x_stocks WHERE rank <= 25)", ["score_date", "rank", "symbol", r6("score")]),
    "r09_rank_changes": (lambda m: m.sectors().withColumn("move", F.abs("rank_change")), "(SELECT *, abs(rank_change) AS move FROM x_sectors)", ["score_date", "sector", "move"]),
}


def _run(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    build, _, columns = _OUT[key]
    return build(Market(spark, sf_dir)).selectExpr(*columns)


QUERIES = {k: partial(_run, k) for k in _OUT}
ORACLE = {k: with_(f"SELECT {', '.join(columns)} FROM {source}") for k, (_, source, columns) in _OUT.items()}

