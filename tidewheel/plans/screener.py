"""Fundamentals screen by sector thresholds, data-quality checks and status counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel import config as C
from tidewheel.functions.expressions import r6, rank_key
from tidewheel.operators import merge, store
from tidewheel.operators.oracle import cte, with_
from tidewheel.plans.labels import Labelled
from tidewheel.plans.scores import Market
from tidewheel.sources.adapter import macro_series, market_events, prices_daily, read

#: Sector, dividend yield over, debt to equity under, P/E under, P/B under; None does not filter.
THRESHOLDS = (
    ("Basic Materials", 2.0, 0.7, 20.0, 3.0),
    ("Communication Services", 2.0, 1.0, 20.0, 3.0),
    ("Consumer Cyclical", 1.0, 0.7, 20.0, 3.0),
    ("Consumer Defensive", 2.0, 0.7, 20.0, 3.0),
    ("Energy", 2.0, 0.7, 20.0, 3.0),
    ("Financial", 2.0, 0.7, 20.0, 3.0),
    ("Healthcare", None, 0.7, 20.0, 3.0),
    ("Industrials", 1.0, 0.7, 20.0, 3.0),
    ("Real Estate", 3.0, None, None, None),
    ("Technology", 1.0, 0.7, 20.0, 3.0),
    ("Utilities", 3.0, None, 20.0, None),
)
COMMON = "market_cap > 2e9 AND eps_growth > 0 AND roa > 0 AND roe > 10 AND net_margin > 0"
BOUNDS = "(min_yield IS NULL OR dividend_yield > min_yield) AND (max_debt IS NULL OR debt_equity < max_debt) AND (max_pe IS NULL OR pe < max_pe) AND (max_pb IS NULL OR pb < max_pb)"


def screen(fundamentals: DataFrame, sectors: DataFrame, extra: DataFrame, order: str = "place") -> DataFrame:
    """fundamentals that pass their sector's thresholds, with the columns of extra by ticker, '' where it has none.

    Of a ticker's rows the first by `order` counts in fundamentals and the last in
    extra. sectors has a row for each of a dozen sectors.
    """
    kept = store.first_of(fundamentals.join(F.broadcast(sectors), "sector").filter(COMMON).filter(BOUNDS), ["ticker"], order)
    last = store.first_of(extra, ["ticker"], order, last=True).drop(order)
    return kept.drop(order).join(last, "ticker", "left").na.fill("", [c for c in last.columns if c != "ticker"])


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*row, n) for n, row in enumerate(THRESHOLDS)], "sector string, min_yield double, max_debt double, max_pe double, max_pb double, no int")


_FUNDAMENTALS = ["p_name AS company", "CAST(p_partkey % 11 AS INT) AS no", "p_retailprice * 1e7 AS market_cap", "CAST(p_partkey % 400 AS DOUBLE) / 100 AS dividend_yield", "CAST(p_partkey % 130 AS DOUBLE) / 100 AS debt_equity", "p_retailprice / 80 AS pe", "CAST(p_size AS DOUBLE) / 12 AS pb", "CAST(p_partkey % 7 AS DOUBLE) - 1 AS eps_growth", "CAST(p_partkey % 5 AS DOUBLE) - 1 AS roa", "CAST(p_size AS DOUBLE) AS roe", "CAST(p_partkey % 3 AS DOUBLE) AS net_margin"]
_TICKER = "concat('P', lpad(CAST(p_partkey AS {0}), 8, '0')) AS ticker"
_SHOWN = ["ticker", "company", "sector", "brand"]


def screener(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    limits = thresholds(spark)
    base = part.selectExpr("p_partkey AS place", _TICKER.format("STRING"), *_FUNDAMENTALS).join(F.broadcast(limits.select("no", "sector")), "no")
    return screen(base, limits.drop("no"), part.filter("p_partkey % 4 <> 0").selectExpr("p_partkey AS place", _TICKER.format("STRING"), "p_brand AS brand")).select(*_SHOWN)


_value = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
cte("x_limits", "SELECT * FROM (VALUES " + ", ".join(f"({n}, " + ", ".join(map(_value, row)) + ")" for n, row in enumerate(THRESHOLDS)) + ") AS t(no, sector, min_yield, max_debt, max_pe, max_pb)")
cte("x_fundamentals", f"SELECT {_TICKER.format('VARCHAR')}, p_partkey, p_brand, {', '.join(_FUNDAMENTALS)} FROM part")
_SCREEN_SQL = f"SELECT ticker, company, sector, CASE WHEN p_partkey % 4 <> 0 THEN p_brand ELSE '' END AS brand FROM x_fundamentals JOIN x_limits USING (no) WHERE {COMMON} AND {BOUNDS}"


def coverage(market: Market) -> DataFrame:
    """Bars of every required symbol: count, first and last date; zero where none came."""
    need = market.symbols.filter("asset_type = 'etf'").select("symbol")
    seen = market.etfs.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return need.join(seen, "symbol", "left").na.fill(0, ["n"])


MIN_BARS = 61


def doctor(market: Market) -> DataFrame:
    """(symbol, enough, current): whether a required symbol has enough bars and the benchmark's last date."""
    found = coverage(market)
    spy = found.filter("symbol = 'SPY'").select(F.col("last_date").alias("spy_date"))
    return found.crossJoin(F.broadcast(spy)).selectExpr("symbol", f"n >= {MIN_BARS} AS enough", "coalesce(last_date = spy_date, false) AS current_")  # one row


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, n): rows of every table, and the score dates."""
    m = Market(spark, sf_dir)
    tables = {"symbols": m.symbols, "sector_map": m.funds, "prices_daily": m.bars, "macro_series": macro_series(spark, sf_dir), "events": market_events(spark, sf_dir), "score_dates": m.dates, "sector_scores": m.sectors(), "stock_scores": m.stock_scores(), "watchlists": m.stock_scores().filter(f"rank <= {C.WATCHLIST}")}
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


MIN_SCORE_DATES = 60


def expectations(m: Labelled) -> DataFrame:
    """(rule, found, expected, ok): what a complete store holds.

    Required symbols, sector map and macro series have rows; required symbols have
    enough bars, up to the benchmark's last day; there are enough score dates, the
    last one is the benchmark's last day, and it has its regime, sectors,
    industries, stocks and watchlist.
    """
    one = lambda df, rule, found, expected, test: df.agg(F.expr(f"CAST({found} AS BIGINT) AS found"), F.expr(f"CAST({expected} AS BIGINT) AS expected")).selectExpr(f"'{rule}' AS rule", "found", "expected", f"coalesce({test}, false) AS ok")
    bars, funds = coverage(m), m.funds
    checked = doctor(m)
    series = m.spark.range(1).selectExpr("inline(array(" + ", ".join(f"named_struct('series', '{s}')" for s, _ in C.MACRO_SERIES) + "))").join(m.series.select("series").distinct().withColumn("there", F.lit(1)), "series", "left")
    last = m.bars.filter("symbol = 'SPY'").agg(F.max("date").alias("day"))
    dated = m.dates.agg(F.count(F.lit(1)).alias("n"), F.max("score_date").alias("d")).crossJoin(last)  # one row
    latest = lambda df: df.join(F.broadcast(m.dates.agg(F.max("score_date").alias("score_date"))), "score_date")  # noqa: E731  one row
    sectors = funds.count()  # a dozen
    rules = [
        one(bars, "required_symbols", "count_if(n > 0)", "count(*)", "found = expected"),
        one(funds, "sector_map", "count(sector_etf)", "count(*)", "found = expected"),
        one(checked, "price_bars", "count_if(enough AND current_)", "count(*)", "found = expected"),
        one(series, "macro_series", "count(there)", "count(*)", "found = expected"),
        one(dated, "score_dates", "max(n)", f"{MIN_SCORE_DATES}", "found >= expected"),
        one(dated, "latest_score_date", "unix_date(max(d))", "unix_date(max(day))", "found = expected"),
        one(latest(m.regime()), "latest_regime", "count(*)", "1", "found = expected"),
        one(latest(m.sectors()), "latest_sectors", "count(*)", str(sectors), "found = expected"),
        one(latest(m.industries()), "latest_industries", "count(*)", "1", "found >= expected"),
        one(latest(m.stock_scores()), "latest_stocks", "count(*)", str(C.STORED_STOCKS), "found = expected"),
        one(latest(m.stock_scores().filter(f"rank <= {C.WATCHLIST}")), "latest_watchlist", "count(*)", str(C.WATCHLIST), "found = expected"),
    ]
    return reduce(DataFrame.unionByName, rules)


_EXPECT_SQL = f"""SELECT rule, found, expected, coalesce(CASE WHEN rule IN ('score_dates', 'latest_industries') THEN found >= expected ELSE found = expected END, false) AS ok FROM (
SELECT 'required_symbols' AS rule, count(*) FILTER (WHERE n > 0) AS found, count(*) AS expected FROM x_coverage
UNION ALL SELECT 'sector_map', count(sector_etf), count(*) FROM x_sector_map
UNION ALL SELECT 'price_bars', count(*) FILTER (WHERE n >= {MIN_BARS} AND last_date = (SELECT max(date) FROM x_prices WHERE symbol = 'SPY')), count(*) FROM x_coverage
UNION ALL SELECT 'macro_series', (SELECT count(DISTINCT series) FROM x_macro), count(*) FROM x_series_names
UNION ALL SELECT 'score_dates', count(*), {MIN_SCORE_DATES} FROM x_dates
UNION ALL SELECT 'latest_score_date', max(score_date) - DATE '1970-01-01', (SELECT max(date) - DATE '1970-01-01' FROM x_prices WHERE symbol = 'SPY') FROM x_dates
UNION ALL SELECT 'latest_regime', count(*), 1 FROM x_regime WHERE score_date = (SELECT max(score_date) FROM x_dates)
UNION ALL SELECT 'latest_sectors', count(*), (SELECT count(*) FROM region) FROM x_sectors WHERE score_date = (SELECT max(score_date) FROM x_dates)
UNION ALL SELECT 'latest_industries', count(*), 1 FROM x_industries WHERE score_date = (SELECT max(score_date) FROM x_dates)
UNION ALL SELECT 'latest_stocks', count(*), {C.STORED_STOCKS} FROM x_stocks WHERE score_date = (SELECT max(score_date) FROM x_dates)
UNION ALL SELECT 'latest_watchlist', count(*), {C.WATCHLIST} FROM x_stocks WHERE rank <= {C.WATCHLIST} AND score_date = (SELECT max(score_date) FROM x_dates))"""

cte("x_screened", _SCREEN_SQL)

# ---- readers of stored tables ---------------------------------------------------



def by_month(m: Market, name: str, build, by: str, first: str, last: str | None = None, *, before: str | None = None) -> DataFrame:
    """Days of a derived table that lies by month: only the months between are read."""
    path = store.stored_folder(m.spark, m.sf_dir, f"{name}-by-month", lambda p: merge.write(build(), p, by))
    return merge.read(m.spark, path, first, last, by=by, before=before)


_DAY, _FROM, _TO, _BEFORE = "1996-06-03", "1995-01-02", "1995-03-31", "1995-04-03"
READS = {
    "p01_scores_of_a_day": (lambda m: by_month(m, "stock_scores", m.stock_scores, "score_date", _DAY, _DAY).selectExpr("symbol", "rank", r6("score")), f"SELECT symbol, rank, {r6('score')} FROM x_stocks WHERE score_date = DATE '{_DAY}'"),
    "p02_prices_of_a_range": (lambda m: by_month(m, "prices", lambda: prices_daily(m.spark, m.sf_dir), "date", _FROM, _TO).filter("symbol = 'SPY'").selectExpr("symbol", "date", r6("close")), f"SELECT symbol, date, {r6('close')} FROM x_prices WHERE symbol = 'SPY' AND date BETWEEN DATE '{_FROM}' AND DATE '{_TO}'"),
    "p03_prices_before_a_day": (lambda m: by_month(m, "prices", lambda: prices_daily(m.spark, m.sf_dir), "date", _FROM, before=_BEFORE).filter("symbol LIKE 'ETF%'").selectExpr("symbol", "date", r6("close")), f"SELECT symbol, date, {r6('close')} FROM x_prices WHERE symbol LIKE 'ETF%' AND date >= DATE '{_FROM}' AND date < DATE '{_BEFORE}'"),
    "p04_symbols_of_a_sector": (lambda m: m.stocks.filter("lower(sector) = lower('Asia') AND startswith(symbol, 'S0000')").select("symbol", "name", "industry"), "SELECT symbol, name, industry FROM x_symbols WHERE asset_type = 'stock' AND upper(sector) = 'ASIA' AND symbol LIKE 'S0000%'"),
    "r11_best_of_the_last_day": (lambda m: m.stock_scores().join(F.broadcast(m.dates.agg(F.max("score_date").alias("score_date"))), "score_date").filter("rank <= 10").select("symbol", "rank"), "SELECT symbol, rank FROM x_stocks WHERE rank <= 10 AND score_date = (SELECT max(score_date) FROM x_dates)"),
    "r08_weak_sectors": (lambda m: m.sectors().selectExpr("*", f"CAST(row_number() OVER (PARTITION BY score_date ORDER BY {rank_key('score')}, sector DESC) AS INT) AS from_below").filter("from_below <= 3").select("score_date", "sector", "from_below"), f"SELECT score_date, sector, from_below FROM (SELECT *, CAST(row_number() OVER (PARTITION BY score_date ORDER BY {rank_key('score')}, sector DESC) AS INT) AS from_below FROM x_sectors) WHERE from_below <= 3"),
}

_COUNT_SQL = " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {t}" for n, t in {"symbols": "x_symbols", "sector_map": "x_sector_map", "prices_daily": "x_bars", "macro_series": "x_macro", "events": "x_events", "score_dates": "x_dates", "sector_scores": "x_sectors", "stock_scores": "x_stocks", "watchlists": "(SELECT * FROM x_stocks WHERE rank <= 25)"}.items())
cte("x_coverage", "SELECT s.symbol, count(b.date) AS n, min(b.date) AS first_date, max(b.date) AS last_date FROM x_symbols s LEFT JOIN x_bars b ON b.symbol = s.symbol WHERE asset_type = 'etf' GROUP BY s.symbol")
QUERIES = {
    "q37_screener": screener,
    "a19_coverage": lambda spark, d: coverage(Market(spark, d)),
    "q34_doctor": lambda spark, d: doctor(Market(spark, d)),
    "q35_status_counts": status_counts,
    "q33_expectations": lambda spark, d: expectations(Labelled(spark, d)),
} | {k: (lambda spark, d, read=read: read(Market(spark, d))) for k, (read, _) in READS.items()}
ORACLE = {
    "q37_screener": with_(_SCREEN_SQL),
    "a19_coverage": with_("SELECT * FROM x_coverage"),
    "q34_doctor": with_(f"SELECT symbol, n >= {MIN_BARS} AS enough, coalesce(last_date = (SELECT last_date FROM x_coverage WHERE symbol = 'SPY'), false) AS current_ FROM x_coverage"),
    "q35_status_counts": with_(_COUNT_SQL),
    "q33_expectations": with_(_EXPECT_SQL),
} | {k: with_(sql) for k, (_, sql) in READS.items()}
