"""What reports and pages show: texts of figures, explanations, overlays, ordered lists, hydrated watchlists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel import config as C
from tidewheel.functions.expressions import decimals, multiple, percent, r6, rank_key
from tidewheel.operators.oracle import cte, with_
from tidewheel.plans.labels import Labelled
from tidewheel.plans.sessions import CALM, Sessions, recursive

#: How long the lists of a report are.
LISTS = {"top_sectors": 5, "bottom_sectors": 5, "top_industries": 10, "top_volume": 10, "explained": 10, "moved_sectors": 10}
FOCUS = 5

#: The explanations, in parts of text and figures.
SECTOR_PARTS = lambda t: ["sector", "' scored '", decimals("score", 1, t), "': 20D return '", percent("r20", t), "', relative return vs SPY '", percent("rel_spy", t), "', relative volume '", multiple("rel_volume", t), "', breadth '", decimals("breadth", 0, t), "'%.'"]
STOCK_PARTS = lambda t: ["symbol", "' scored '", decimals("score", 1, t), "': sector '", "sector", "', 20D relative return vs sector '", percent("rel_sector", t), "', relative volume '", multiple("rel_volume", t), "'.'"]
joined = lambda parts: "(" + " || ".join(parts) + ")"

#: What an overlay says of a regime and its flags.
INTERPRETATION = """CASE WHEN base LIKE 'risk_on%' AND flags <> '' THEN 'ETF-proxy regime is risk-on while macro stress flags are active.'
WHEN (base LIKE 'defensive%' OR base LIKE 'mixed%') AND flags = '' THEN 'ETF-proxy regime is defensive or mixed while no macro stress flags are active.'
WHEN flags = '' THEN 'No active macro stress flags for this report date.'
ELSE 'Macro stress flags are active; treat them as context, not score inputs.' END"""


def overlay(m: Labelled) -> DataFrame:
    """(score_date, flags, stale_series, covered, required, interpretation) of every score date; stale series by name."""
    seen = m.macro().groupBy("score_date").agg(F.count(F.lit(1)).alias("covered"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("stale"), F.col("series")))), "|").alias("stale_series"))  # at most as many as there are series
    rows = m.regime().select("score_date", F.replace(F.lower("label"), F.lit("-"), F.lit("_")).alias("base")).join(m.flags().select("score_date", "flags"), "score_date").join(seen, "score_date", "left")
    return rows.select("score_date", "flags", F.coalesce("stale_series", F.lit("")).alias("stale_series"), F.coalesce("covered", F.lit(0)).alias("covered"), F.lit(len(C.MACRO_SERIES)).alias("required"), F.expr(INTERPRETATION).alias("interpretation"))


def explained_stocks(m: Labelled) -> DataFrame:
    return m.stock_scores().selectExpr("score_date", "symbol", "rank", f"{joined(STOCK_PARTS('STRING'))} AS explanation")


def explained_sectors(m: Labelled) -> DataFrame:
    return m.sectors().selectExpr("score_date", "sector", f"{joined(SECTOR_PARTS('STRING'))} AS explanation")


def listed(rows: DataFrame, name: str, entry: str, order: str, most: int) -> DataFrame:
    """(score_date, list, place, entry): the first `most` rows of each date by order; Spark limits them before they meet."""
    return rows.selectExpr("score_date", f"'{name}' AS list", f"CAST(row_number() OVER (PARTITION BY score_date ORDER BY {order}) AS INT) AS place", f"{entry} AS entry").filter(f"place <= {most}")


_LISTS = {
    # list: (rows of a market, SQL rows, entry, order)
    "top_sectors": (lambda m: m.sectors(), "x_sectors", "sector", "rank"),
    "bottom_sectors": (lambda m: m.sectors(), "x_sectors", "sector", "rank DESC"),
    "top_industries": (lambda m: m.industries(), "x_industries", "sector || '/' || industry", "rank"),
    "top_volume": (lambda m: m.stock_scores(), "x_stocks", "symbol", f"{rank_key('rel_volume')} DESC, rank"),
    "explained": (lambda m: m.stock_scores(), "x_stocks", "symbol", "rank"),
    "moved_sectors": (lambda m: m.sectors(), "x_sectors", "sector", "abs(rank_change) DESC, rank"),
}


def report_lists(m: Labelled) -> DataFrame:
    return reduce(DataFrame.unionByName, [listed(rows(m), k, entry, order, LISTS[k]) for k, (rows, _, entry, order) in _LISTS.items()])


def focus(m: Labelled) -> DataFrame:
    """(score_date, symbols): the first FOCUS of the watchlist, comma-joined by rank."""
    top = m.stock_scores().filter(f"rank <= {FOCUS}")
    return top.groupBy("score_date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol"))), lambda x: x["symbol"]), ", ").alias("symbols"))


def hydrated(watchlist: DataFrame, stocks: DataFrame) -> DataFrame:
    """watchlist (score_date, rank, symbol, score, reason) with what stocks has of each symbol on its day; without it texts are empty, the catalyst pending and measures 0."""
    texts = ("name", "sector", "industry", "primary", "labels")
    figures = ("dist20", "dist50", "atr_ext20", "dist20high")
    own = stocks.select("score_date", "symbol", "catalyst", *texts, *figures)
    out = watchlist.join(own, ["score_date", "symbol"], "left")
    return out.select("score_date", "rank", "symbol", "score", "reason", F.coalesce("catalyst", F.lit(C.PENDING)).alias("catalyst"), *(F.coalesce(c, F.lit("")).alias(c) for c in texts), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in figures))


def hydrated_watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watchlist hydrated from a store that keeps the best 20 stocks of a day: the rest has defaults."""
    m = Labelled(spark, sf_dir)
    watch = m.stock_scores().filter(f"rank <= {C.WATCHLIST}").selectExpr("score_date", "rank", "symbol", "score", f"{joined(STOCK_PARTS('STRING'))} AS reason")
    return hydrated(watch, m.actions().filter("rank <= 20")).selectExpr("score_date", "rank", "symbol", "catalyst", "name", "sector", "primary AS primary_label", "labels", "reason", r6("dist20"))


def ordered_setups(s: Sessions) -> DataFrame:
    """Each day's candidates as a page lists them: those furthest in the funnel first, then by their place."""
    rows = s.readiness()
    return rows.selectExpr("date", "symbol", "stage2", "stage3", "CAST(row_number() OVER (PARTITION BY date ORDER BY stage3 DESC, stage2 DESC, place, symbol) AS INT) AS line")


def page_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shown, n): what a page's filters leave: setups of the second and third stage, series without observations, buckets that hold somebody."""
    m, s = Labelled(spark, sf_dir), Sessions(spark, sf_dir, CALM)
    setups = s.readiness().agg(F.count_if("stage2").alias("structural_setups"), F.count_if("stage3").alias("ready_setups"))
    series = spark.createDataFrame([(x,) for x, _ in C.MACRO_SERIES], "series string").join(m.series.filter("value < 0").groupBy("series").agg(F.count(F.lit(1)).alias("n")), "series", "left").agg(F.count_if(F.col("n").isNull()).alias("series_without"))
    buckets = m.actions().agg(F.count_distinct("primary").alias("filled_buckets"))
    one = setups.crossJoin(series).crossJoin(buckets)  # one row each
    return one.selectExpr("inline(array(" + ", ".join(f"named_struct('shown', '{c}', 'n', {c})" for c in one.columns) + "))")


cte("x_exp_stocks", f"SELECT score_date, symbol, rank, {joined(STOCK_PARTS('VARCHAR'))} AS explanation FROM x_stocks")
cte("x_exp_sectors", f"SELECT score_date, sector, {joined(SECTOR_PARTS('VARCHAR'))} AS explanation FROM x_sectors")
_LIST_SQL = " UNION ALL ".join(f"SELECT * FROM (SELECT score_date, '{k}' AS list, CAST(row_number() OVER (PARTITION BY score_date ORDER BY {order}) AS INT) AS place, {entry} AS entry FROM {sql}) WHERE place <= {LISTS[k]}" for k, (_, sql, entry, order) in _LISTS.items())
_HYDRATED_SQL = f"SELECT w.score_date, w.rank, w.symbol, coalesce(a.catalyst, '{C.PENDING}') AS catalyst, coalesce(a.name, '') AS name, coalesce(a.sector, '') AS sector, coalesce(a.primary_, '') AS primary_label, coalesce(a.labels, '') AS labels, e.explanation AS reason, {r6('coalesce(a.dist20, 0)', 'dist20')} FROM x_top w JOIN x_exp_stocks e ON e.score_date = w.score_date AND e.symbol = w.symbol LEFT JOIN (SELECT * FROM x_action WHERE rank <= 20) a ON a.score_date = w.score_date AND a.symbol = w.symbol"
_OVERLAY_SQL = f"SELECT score_date, flags, stale_series, covered, {len(C.MACRO_SERIES)} AS required, {INTERPRETATION} AS interpretation FROM (SELECT f.score_date, f.flags, replace(lower(g.label), '-', '_') AS base, coalesce(s.stale_series, '') AS stale_series, coalesce(s.covered, 0) AS covered FROM x_flags f JOIN x_regime g ON g.score_date = f.score_date LEFT JOIN (SELECT score_date, count(*) AS covered, coalesce(string_agg(series, '|' ORDER BY series) FILTER (WHERE stale), '') AS stale_series FROM x_macro_asof GROUP BY score_date) s ON s.score_date = f.score_date)"
_S = lambda spark, d: Sessions(spark, d, CALM)
QUERIES = {
    "q17_macro_overlay": lambda spark, d: overlay(Labelled(spark, d)),
    "x09_stock_explanations": lambda spark, d: explained_stocks(Labelled(spark, d)),
    "x09_sector_explanations": lambda spark, d: explained_sectors(Labelled(spark, d)),
    "r02_report_lists": lambda spark, d: report_lists(Labelled(spark, d)),
    "r14_focus_symbols": lambda spark, d: focus(Labelled(spark, d)),
    "j12_hydrated_watchlist": hydrated_watchlist,
    "r11_ordered_setups": lambda spark, d: ordered_setups(_S(spark, d)),
    "p12_page_filters": page_filters,
}
ORACLE = {
    "q17_macro_overlay": with_(_OVERLAY_SQL),
    "x09_stock_explanations": with_("SELECT score_date, symbol, rank, explanation FROM x_exp_stocks"),
    "x09_sector_explanations": with_("SELECT score_date, sector, explanation FROM x_exp_sectors"),
    "r02_report_lists": with_(_LIST_SQL),
    "r14_focus_symbols": with_(f"SELECT score_date, string_agg(symbol, ', ' ORDER BY rank) AS symbols FROM x_stocks WHERE rank <= {FOCUS} GROUP BY score_date"),
    "j12_hydrated_watchlist": with_(_HYDRATED_SQL),
    "r11_ordered_setups": recursive("SELECT date, symbol, stage2, stage3, CAST(row_number() OVER (PARTITION BY date ORDER BY stage3 DESC, stage2 DESC, place, symbol) AS INT) AS line FROM x_sready"),
    "p12_page_filters": recursive(f"SELECT 'structural_setups' AS shown, count(*) FILTER (WHERE stage2) AS n FROM x_sready UNION ALL SELECT 'ready_setups', count(*) FILTER (WHERE stage3) FROM x_sready UNION ALL SELECT 'series_without', {len(C.MACRO_SERIES)} - (SELECT count(DISTINCT series) FROM x_macro WHERE value < 0) UNION ALL SELECT 'filled_buckets', (SELECT count(DISTINCT primary_) FROM x_action)"),
}
