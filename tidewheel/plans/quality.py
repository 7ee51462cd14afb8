"""What a store lacks and what it holds: lists of what is missing, coverage by symbol, series and date, rows of all tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel import config as C
from tidewheel.operators.oracle import cte, with_
from tidewheel.plans.backtest import Tested, grouped
from tidewheel.plans.labels import Labelled
from tidewheel.plans.scores import Market
from tidewheel.plans.screener import MIN_BARS, screener
from tidewheel.plans.sessions import CALM, Sessions, recursive

#: What the queries require besides the given tables' own symbols, sectors and series; none of it is there.
ALSO = {"symbols": ("ETF_ANTARCTICA",), "sectors": (("ANTARCTICA", "ETF_ANTARCTICA"),), "series": ("GDPC1",)}


def covered(required: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, n, first_date, last_date) of every required key; zero and null where there are no rows."""
    seen = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return required.select(key).join(seen, key, "left").na.fill(0, ["n"])


def missing(symbols: DataFrame, funds: DataFrame, bars: DataFrame, series: DataFrame, required: DataFrame, required_funds: DataFrame, required_series: DataFrame, benchmark: str = "SPY") -> DataFrame:
    """(kind, name, detail), one row for each thing that is required and not there.

    kind: `symbol`, `sector_map`, `price_bars` (none, fewer than MIN_BARS, or not up
    to the benchmark's last day) and `macro_series`. Required lists are as long as a
    list of funds or series, so they are joined to counts, never to rows.
    """
    no_symbol = required.join(symbols.select("symbol"), "symbol", "left_anti").selectExpr("'symbol' AS kind", "symbol AS name", "'' AS detail")
    no_fund = required_funds.join(funds.select("sector", "sector_etf"), ["sector", "sector_etf"], "left_anti").selectExpr("'sector_map' AS kind", "concat(sector, '/', sector_etf) AS name", "'' AS detail")
    last = bars.filter(F.col("symbol") == benchmark).agg(F.max("date").alias("day"))
    held = covered(required, bars, "symbol").crossJoin(F.broadcast(last))  # one row
    no_bars = held.filter(f"n < {MIN_BARS} OR last_date < day").selectExpr("'price_bars' AS kind", "symbol AS name", f"CASE WHEN n = 0 THEN 'none' WHEN n < {MIN_BARS} THEN concat(CAST(n AS STRING), ' bars') ELSE concat('up to ', CAST(last_date AS STRING)) END AS detail")
    no_series = covered(required_series, series, "series").filter("n = 0").selectExpr("'macro_series' AS kind", "series AS name", "'none' AS detail")
    return reduce(DataFrame.unionByName, [no_symbol, no_fund, no_bars, no_series])


def _list(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def missing_of_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Labelled(spark, sf_dir)
    need = m.symbols.filter("asset_type = 'etf' OR industry LIKE 'A%'").select("symbol").union(_list(spark, [(s,) for s in ALSO["symbols"]], "symbol string"))
    funds = m.funds.select("sector", "sector_etf").union(_list(spark, ALSO["sectors"], "sector string, sector_etf string"))
    series = _list(spark, [(s,) for s, _ in C.MACRO_SERIES] + [(s,) for s in ALSO["series"]], "series string")
    return missing(m.symbols, m.funds, m.bars, m.series, need, funds, series)


def series_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = Labelled(spark, sf_dir)
    return covered(_list(spark, [(s,) for s, _ in C.MACRO_SERIES] + [(s,) for s in ALSO["series"]], "series string"), m.series, "series")


def rows_by_date(m: Market) -> DataFrame:
    """(score_date, regimes, sectors, industries, stocks, watchlist): rows of every score date in each table."""
    tables = {"regimes": m.regime(), "sectors": m.sectors(), "industries": m.industries(), "stocks": m.stock_scores(), "watchlist": m.stock_scores().filter(f"rank <= {C.WATCHLIST}")}
    long = reduce(DataFrame.unionByName, [df.groupBy("score_date").agg(F.count(F.lit(1)).alias("n")).withColumn("t", F.lit(k)) for k, df in tables.items()])
    wide = long.groupBy("score_date").agg(*(F.sum(F.when(F.col("t") == k, F.col("n")).otherwise(0)).alias(k) for k in tables))
    return m.dates.join(wide, "score_date", "left").na.fill(0)


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, n): rows of all sixteen tables; score dates count once."""
    m, s = Tested(spark, sf_dir), Sessions(spark, sf_dir, CALM)
    backtest = grouped(m.observations(), "entity, horizon, decile", "relative", ("relative",))
    tables = {"symbols": m.symbols, "prices_daily": m.bars, "macro_series": m.series, "events": m.events, "market_regime_scores": m.regime(), "score_dates": m.sectors().select("score_date").distinct(), "sector_scores": m.sectors(), "industry_scores": m.industries(), "stock_scores": m.stock_scores(), "watchlists": m.stock_scores().filter(f"rank <= {C.WATCHLIST}"), "backtest_results": backtest, "prices_intraday": s.bars, "volume_profiles": s.profiles(), "intraday_setups": s.readiness(), "intraday_triggers": s.triggers(), "screener_cache": screener(spark, sf_dir)}
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("table_name"), "n") for k, df in tables.items()])


_values = lambda rows: "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows) + ")"
cte("x_need", f"SELECT symbol FROM x_symbols WHERE asset_type = 'etf' OR industry LIKE 'A%' UNION ALL SELECT * FROM {_values([(s,) for s in ALSO['symbols']])} AS t(symbol)")
cte("x_need_seen", "SELECT n.symbol, count(p.date) AS n, max(p.date) AS last_date FROM x_need n LEFT JOIN x_prices p ON p.symbol = n.symbol GROUP BY n.symbol")
cte("x_need_series", f"SELECT series FROM x_series_names UNION ALL SELECT * FROM {_values([(s,) for s in ALSO['series']])} AS t(series)")
_MISSING_SQL = f"""SELECT 'symbol' AS kind, symbol AS name, '' AS detail FROM x_need WHERE symbol NOT IN (SELECT symbol FROM x_symbols)
UNION ALL SELECT 'sector_map', sector || '/' || sector_etf, '' FROM {_values(ALSO['sectors'])} AS t(sector, sector_etf) WHERE (sector, sector_etf) NOT IN (SELECT (sector, sector_etf) FROM x_sector_map)
UNION ALL SELECT 'price_bars', symbol, CASE WHEN n = 0 THEN 'none' WHEN n < {MIN_BARS} THEN n || ' bars' ELSE 'up to ' || CAST(last_date AS VARCHAR) END FROM x_need_seen WHERE n < {MIN_BARS} OR last_date < (SELECT max(date) FROM x_prices WHERE symbol = 'SPY')
UNION ALL SELECT 'macro_series', series, 'none' FROM x_need_series WHERE series NOT IN (SELECT series FROM x_macro)"""
_COUNTED = {"symbols": "x_symbols", "prices_daily": "x_prices", "macro_series": "x_macro", "events": "x_events", "market_regime_scores": "x_regime", "score_dates": "x_dates", "sector_scores": "x_sectors", "industry_scores": "x_industries", "stock_scores": "x_stocks", "watchlists": "x_top", "backtest_results": "(SELECT DISTINCT entity, horizon, decile FROM x_obs)", "prices_intraday": "x_sbars", "volume_profiles": "(SELECT DISTINCT symbol, date, timeframe FROM x_sbars)", "intraday_setups": "(SELECT * FROM x_sstage1 WHERE candidate)", "intraday_triggers": "(SELECT * FROM x_strig WHERE hit)", "screener_cache": "x_screened"}

QUERIES = {
    "q33_missing": missing_of_market,
    "a19_series_coverage": series_coverage,
    "a19_rows_by_date": lambda spark, d: rows_by_date(Market(spark, d)),
    "q35_table_counts": table_counts,
}
ORACLE = {
    "q33_missing": with_(_MISSING_SQL),
    "a19_series_coverage": with_("SELECT n.series, count(m.date) AS n, min(m.date) AS first_date, max(m.date) AS last_date FROM x_need_series n LEFT JOIN x_macro m ON m.series = n.series GROUP BY n.series"),
    "a19_rows_by_date": with_("SELECT d.score_date, coalesce(g.n, 0) AS regimes, coalesce(s.n, 0) AS sectors, coalesce(i.n, 0) AS industries, coalesce(k.n, 0) AS stocks, coalesce(w.n, 0) AS watchlist FROM x_dates d " + " ".join(f"LEFT JOIN (SELECT score_date, count(*) AS n FROM {t} GROUP BY score_date) {a} ON {a}.score_date = d.score_date" for a, t in (("g", "x_regime"), ("s", "x_sectors"), ("i", "x_industries"), ("k", "x_stocks"), ("w", "x_top")))),
    "q35_table_counts": recursive(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {t}" for n, t in _COUNTED.items())),
}
