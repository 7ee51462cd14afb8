"""The market tables, derived from the star-schema tables.

Prices come from line items: each contributes to its supplier (a stock), the
benchmark SPY, its region's fund and its part type's proxy. Sums are over
integers, so that any order of rows gives the same bits. Line items are stored by
stock; stocks' prices and all that is computed of a stock's bars come from there
without a shuffle, funds' prices are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel import config as C
from tidewheel.functions.expressions import r6
from tidewheel.operators.oracle import cte, with_
from tidewheel.operators.store import stamp, stored, stored_by


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stock_symbol(key: str) -> str:
    return f"concat('S', lpad(CAST({key} AS STRING), 6, '0'))"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, name, asset_type, sector, industry): stocks, the benchmark, sector funds and proxies."""
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    stocks = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(f"{stock_symbol('s_suppkey')} AS symbol", "s_name AS name", "'stock' AS asset_type", "r_name AS sector", "n_name AS industry")
    none = "CAST(NULL AS STRING) AS sector", "CAST(NULL AS STRING) AS industry"
    funds = read(spark, sf_dir, "region").selectExpr("concat('ETF_', r_name) AS symbol", "concat('ETF_', r_name) AS name", "'etf' AS asset_type", *none)
    proxies = read(spark, sf_dir, "part").select("p_type").distinct().selectExpr("concat('PX_', p_type) AS symbol", "concat('PX_', p_type) AS name", "'etf' AS asset_type", *none)
    spy = spark.range(1).selectExpr("'SPY' AS symbol", "'SPY' AS name", "'etf' AS asset_type", *none)
    return stocks.unionByName(funds).unionByName(proxies).unionByName(spy)


def sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "region").selectExpr("r_name AS sector", "concat('ETF_', r_name) AS sector_etf")


#: Bytes of the line items' file for each bucket: about a million rows.
BUCKET_BYTES, MIN_BUCKETS = 16 << 20, 8


def stock_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, fund, proxy, date, c, q) of every line item, stored by symbol: its stock, sector fund and proxy, price in cents and quantity."""
    size = next((n for name, n, _ in stamp(spark, sf_dir)[1:] if name == "lineitem"), 0)
    parts = max(MIN_BUCKETS, -(-size // BUCKET_BYTES))
    return stored_by(spark, sf_dir, "lines", "symbol", "date", parts, lambda: _stock_lines(spark, sf_dir, parts))


def _stock_lines(spark: SparkSession, sf_dir: str, parts: int) -> DataFrame:
    part = read(spark, sf_dir, "part").selectExpr("p_partkey", "p_type", "CAST(round(p_retailprice * 100) AS BIGINT) AS c")
    nation = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr("n_nationkey", "concat('ETF_', r_name) AS fund")
    supplier = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_suppkey", f"{stock_symbol('s_suppkey')} AS stock", "fund")
    lines = read(spark, sf_dir, "lineitem").selectExpr("l_partkey", "l_suppkey", "CAST(l_shipdate AS DATE) AS date", "CAST(l_quantity AS BIGINT) AS q")
    # lines are dealt by symbol, but carry keys and types; the names are made of them where they arrive
    symbol = F.expr(stock_symbol("l_suppkey"))
    priced = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).drop("l_partkey", "p_partkey").repartition(parts, symbol).withColumn("symbol", symbol)
    # the symbol is the only key, so that rows stay where their bucket is; the difference tells keys apart that share a symbol
    joined = priced.join(supplier, (F.col("symbol") == F.col("stock")) & (F.col("l_suppkey") - F.col("s_suppkey") == 0))
    return joined.selectExpr("symbol", "fund", "concat('PX_', p_type) AS proxy", "date", "c", "q")


def stock_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prices(stock_lines(spark, sf_dir).select("symbol", "date", "c", "q"))


def fund_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of the benchmark, the funds and the proxies, a dozen symbols."""
    each = lambda: stock_lines(spark, sf_dir).select("date", "c", "q", F.explode(F.array(F.lit("SPY"), F.col("fund"), F.col("proxy"))).alias("symbol"))
    return stored(spark, sf_dir, "fund_prices", lambda: _prices(each()))


def prices_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, open, high, low, close, ac, volume), one row for each symbol and day; ac is the adjusted close."""
    return stock_prices(spark, sf_dir).unionByName(fund_prices(spark, sf_dir))


def _prices(each: DataFrame) -> DataFrame:
    return each.groupBy("symbol", "date").agg(
        F.expr("sum(c) / count(c) / 100").alias("open"),
        F.expr("max(c) / 100").alias("high"),
        F.expr("min(c) / 100").alias("low"),
        F.expr("sum(c * q) / sum(q) / 100").alias("close"),
        F.expr("sum(c * q) / sum(q) / 100").alias("ac"),
        F.expr("CAST(sum(q) * 1000 AS DOUBLE)").alias("volume"),
    )


SERIES_VALUE = "CASE series WHEN 'VIXCLS' THEN mean / 12500 WHEN 'T10Y2Y' THEN (mean - 250000) / 100000 ELSE mean / 1000 END"


def macro_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, frequency, date, value): orders by priority and status, in the order of their names."""
    orders = read(spark, sf_dir, "orders").selectExpr("o_orderpriority AS p", "o_orderstatus AS s", "CAST(o_orderdate AS DATE) AS d", "CAST(round(o_totalprice * 100) AS BIGINT) AS c")
    named = ", ".join(f"named_struct('no', {k + 1}, 'series', '{s}', 'frequency', '{f}')" for k, (s, f) in enumerate(C.MACRO_SERIES))
    names = spark.range(1).selectExpr(f"inline(array({named}))")
    combos = orders.select("p", "s").distinct().selectExpr("p", "s", "row_number() OVER (ORDER BY p, s) AS no").join(F.broadcast(names), "no")
    dated = orders.join(F.broadcast(combos), ["p", "s"]).withColumn("date", F.expr("CASE frequency WHEN 'Weekly' THEN CAST(date_trunc('week', d) AS DATE) WHEN 'Monthly' THEN CAST(date_trunc('month', d) AS DATE) ELSE d END"))
    return dated.groupBy("series", "frequency", "date").agg(F.expr("sum(c) / count(c) / 100").alias("mean")).selectExpr("series", "frequency", "date", f"{SERIES_VALUE} AS value")


EVENT_SHIFT_DAYS = 8122


def market_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, symbol, date, event_type, headline): news, earnings and filings of stocks."""
    n = read(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))
    events = read(spark, sf_dir, "events").filter("event_type IN ('view', 'purchase', 'error')").crossJoin(F.broadcast(n))  # one row
    k = "CAST(get_json_object(props, '$.k') AS INT)"
    based = events.selectExpr("event_id", f"{stock_symbol('user_id % n')} AS symbol", f"date_sub(CAST(ts AS DATE), {EVENT_SHIFT_DAYS}) AS day", "event_type AS t", f"{k} AS k")
    typed = based.selectExpr(
        "event_id",
        "symbol",
        "CASE WHEN t = 'purchase' THEN date_add(day, 30) ELSE day END AS date",
        "CASE t WHEN 'view' THEN 'news' WHEN 'purchase' THEN 'earnings' ELSE 'filing' END AS event_type",
        "CASE t WHEN 'error' THEN concat(element_at(array('8-K', '10-Q', '10-K'), CAST(pmod(k, 3) + 1 AS INT)), ' filed by ', symbol) ELSE concat(t, ' of ', symbol) END AS headline",
    )
    return typed


cte("x_symbols", "SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS symbol, s_name AS name, 'stock' AS asset_type, r_name AS sector, n_name AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'ETF_' || r_name, 'ETF_' || r_name, 'etf', NULL, NULL FROM region UNION ALL SELECT DISTINCT 'PX_' || p_type, 'PX_' || p_type, 'etf', NULL, NULL FROM part UNION ALL SELECT 'SPY', 'SPY', 'etf', NULL, NULL")
cte("x_sector_map", "SELECT r_name AS sector, 'ETF_' || r_name AS sector_etf FROM region")
cte(
    "x_prices",
    """SELECT symbol, date, sum(c) / count(c) / 100 AS open, max(c) / 100 AS high, min(c) / 100 AS low, sum(c * q) / sum(q) / 100 AS close, sum(c * q) / sum(q) / 100 AS ac, CAST(sum(q) * 1000 AS DOUBLE) AS volume
FROM (SELECT CAST(l_shipdate AS DATE) AS date, CAST(round(p_retailprice * 100) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS q,
  unnest(['S' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0'), 'SPY', 'ETF_' || r_name, 'PX_' || p_type]) AS symbol
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
GROUP BY symbol, date""",
)
cte("x_series_names", "SELECT * FROM (VALUES " + ", ".join(f"({k + 1}, '{s}', '{f}')" for k, (s, f) in enumerate(C.MACRO_SERIES)) + ") AS t(no, series, frequency)")
cte(
    "x_macro",
    f"""SELECT series, frequency, date, {SERIES_VALUE} AS value FROM (
  SELECT series, frequency, date, sum(c) / count(c) / 100 AS mean FROM (
    SELECT series, frequency, CASE frequency WHEN 'Weekly' THEN CAST(date_trunc('week', o_orderdate) AS DATE) WHEN 'Monthly' THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE CAST(o_orderdate AS DATE) END AS date, CAST(round(o_totalprice * 100) AS BIGINT) AS c
    FROM orders JOIN (SELECT p, s, row_number() OVER (ORDER BY p, s) AS no FROM (SELECT DISTINCT o_orderpriority AS p, o_orderstatus AS s FROM orders)) k ON o_orderpriority = p AND o_orderstatus = s JOIN x_series_names USING (no))
  GROUP BY series, frequency, date)""",
)
cte(
    "x_events",
    f"""SELECT event_id, symbol, CASE WHEN t = 'purchase' THEN day + 30 ELSE day END AS date,
  CASE t WHEN 'view' THEN 'news' WHEN 'purchase' THEN 'earnings' ELSE 'filing' END AS event_type,
  CASE t WHEN 'error' THEN (['8-K', '10-Q', '10-K'])[CAST(k % 3 + 1 AS INT)] || ' filed by ' || symbol ELSE t || ' of ' || symbol END AS headline
FROM (SELECT event_id, 'S' || lpad(CAST(user_id % (SELECT count(*) FROM supplier) AS VARCHAR), 6, '0') AS symbol, CAST(ts AS DATE) - {EVENT_SHIFT_DAYS} AS day, event_type AS t, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type IN ('view', 'purchase', 'error'))""",
)

ROUNDED = [r6("open"), r6("high"), r6("low"), r6("close"), "volume"]
QUERIES = {
    "s01_prices_daily": lambda spark, d: prices_daily(spark, d).selectExpr("symbol", "date", *ROUNDED),
    "s04_macro_series": lambda spark, d: macro_series(spark, d).selectExpr("series", "frequency", "date", r6("value")),
    "s03_market_events": lambda spark, d: market_events(spark, d),
    "s12_symbols": lambda spark, d: symbols(spark, d).na.fill(""),
    "s12_sector_map": sector_map,
}
ORACLE = {
    "s01_prices_daily": with_("SELECT symbol, date, " + ", ".join(ROUNDED) + " FROM x_prices"),
    "s04_macro_series": with_(f"SELECT series, frequency, date, {r6('value')} FROM x_macro"),
    "s03_market_events": with_("SELECT * FROM x_events"),
    "s12_symbols": with_("SELECT symbol, name, asset_type, coalesce(sector, '') AS sector, coalesce(industry, '') AS industry FROM x_symbols"),
    "s12_sector_map": with_("SELECT * FROM x_sector_map"),
}
