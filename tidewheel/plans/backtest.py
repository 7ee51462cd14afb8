"""Forward-return deciles of the scores, and the validators of events, labels and macro flags."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel import config as C
from tidewheel.functions.expressions import r6, rank_key
from tidewheel.operators.oracle import cte, with_
from tidewheel.plans.labels import Labelled

COMPONENTS = {"return_5d": "r5", "return_20d": "r20", "return_60d": "r60", "relative_return_vs_spy": "rel_spy", "relative_volume": "rel_volume", "breadth": "breadth", "rank_change": "rank_change"}
MEASURES = ("ret", "relative", "vs_spy", "vs_sector")
OBSERVED = ("entity", "score_date", "horizon", "decile", *MEASURES)


def decile(value: str, by: str, tie: str) -> str:
    """Tenths of the ascending order: ceil(10 r / n). Ties keep the order of `tie`."""
    return f"CAST(ceil(row_number() OVER (PARTITION BY {by} ORDER BY {rank_key(value)}, {tie}) * {C.DECILES}.0 / count(*) OVER (PARTITION BY {by})) AS INT)"


def forward(bars: DataFrame) -> DataFrame:
    """(symbol, date, horizon, ret): returns over the next bars, by the bar's own date."""
    pairs = ", ".join(f"named_struct('horizon', {h}, 'ret', fwd{h})" for h in C.HORIZONS)
    return bars.selectExpr("symbol", "date", f"inline(array({pairs}))").filter("ret IS NOT NULL")


#: What a stock's score carries of its bar: the bar's day and its returns ahead.
AHEAD = ["bar_date", *(f"fwd{h}" for h in C.HORIZONS)]
_AHEAD = "inline(array(" + ", ".join(f"named_struct('horizon', {h}, 'ret', CASE WHEN bar_date = score_date THEN fwd{h} END)" for h in C.HORIZONS) + "))"


def with_forward(rows: DataFrame, fwd: DataFrame, funds: DataFrame) -> DataFrame:
    """rows (score_date, symbol, sector, AHEAD, ...) with ret, vs_sector and vs_spy where stock, fund and benchmark all have one.

    A stock's own returns are those of the bar in effect if it is the day's; fwd has funds' and the benchmark's.
    """
    own = fwd.withColumnRenamed("date", "score_date")
    fund = own.join(F.broadcast(funds), F.col("symbol") == F.col("sector_etf")).select("score_date", "horizon", "sector", F.col("ret").alias("fund_ret"))  # as many rows as the map has sectors
    spy = own.filter("symbol = 'SPY'").select("score_date", "horizon", F.col("ret").alias("spy_ret"))
    each = rows.selectExpr("*", _AHEAD).filter("ret IS NOT NULL").drop(*AHEAD)
    joined = each.join(fund, ["score_date", "horizon", "sector"]).join(spy, ["score_date", "horizon"])
    return joined.selectExpr("*", "ret - fund_ret AS vs_sector", "ret - spy_ret AS vs_spy")


_FWD = ", ".join(f"fwd{h}" for h in C.HORIZONS)
cte("x_fwd", f"SELECT symbol, date, horizon, ret FROM (SELECT symbol, date, unnest([{', '.join(map(str, C.HORIZONS))}]) AS horizon, unnest([{_FWD}]) AS ret FROM x_bars) WHERE ret IS NOT NULL")
cte("x_fund_fwd", "SELECT f.date AS score_date, m.sector, f.horizon, f.ret AS fund_ret, p.ret AS spy_ret FROM x_fwd f JOIN x_sector_map m ON f.symbol = m.sector_etf JOIN x_fwd p ON p.symbol = 'SPY' AND p.date = f.date AND p.horizon = f.horizon")
_JOINED = "SELECT s.*, f.horizon, f.ret, f.ret - u.fund_ret AS vs_sector, f.ret - u.spy_ret AS vs_spy FROM {rows} s JOIN x_fwd f ON f.symbol = s.symbol AND f.date = s.score_date JOIN x_fund_fwd u ON u.score_date = s.score_date AND u.sector = s.sector AND u.horizon = f.horizon"


class Tested(Labelled):
    """A Labelled market with forward returns."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        self.fwd = forward(self.etfs)

    def sector_rows(self) -> DataFrame:
        return self.sectors()

    def _sector_forward(self, rows: DataFrame) -> DataFrame:
        own = self.fwd.withColumnRenamed("date", "score_date")
        spy = own.filter("symbol = 'SPY'").select("score_date", "horizon", F.col("ret").alias("spy_ret"))
        return rows.join(own.withColumnRenamed("symbol", "sector_etf"), ["score_date", "sector_etf"]).join(spy, ["score_date", "horizon"]).selectExpr("*", "ret - spy_ret AS relative", "ret - spy_ret AS vs_spy", "CAST(NULL AS DOUBLE) AS vs_sector")

    def sector_observations(self) -> DataFrame:
        rows = self.sectors().withColumn("decile", F.expr(decile("score", "score_date", "rank"))).withColumn("entity", F.lit("sector"))
        return self._sector_forward(rows).select(*OBSERVED)

    def component_observations(self) -> DataFrame:
        parts = ", ".join(f"named_struct('entity', 'sector_component_{k}', 'value', CAST({c} AS DOUBLE))" for k, c in COMPONENTS.items())
        rows = self.sectors().selectExpr("score_date", "sector_etf", "rank", f"inline(array({parts}))").withColumn("decile", F.expr(decile("value", "score_date, entity", "rank")))
        return self._sector_forward(rows).select(*OBSERVED)

    def stock_observations(self) -> DataFrame:
        rows = self.stock_scores().withColumn("decile", F.expr(decile("score", "score_date", "rank"))).withColumn("entity", F.lit("stock"))
        return with_forward(rows.select("entity", "score_date", "symbol", "sector", "decile", *AHEAD), self.fwd, self.funds).withColumn("relative", F.col("vs_sector")).select(*OBSERVED)

    def industry_observations(self) -> DataFrame:
        placed = self.industries().withColumn("decile", F.expr(decile("score", "score_date", "rank"))).select("score_date", "sector", "industry", "decile")
        rows = self.stock_scores().select("score_date", "symbol", "sector", "industry", *AHEAD).join(placed, ["score_date", "sector", "industry"]).withColumn("entity", F.lit("stock_by_industry"))
        return with_forward(rows, self.fwd, self.funds).withColumn("relative", F.col("vs_sector")).select(*OBSERVED)

    def observations(self) -> DataFrame:
        return self.sector_observations().unionByName(self.component_observations()).unionByName(self.stock_observations()).unionByName(self.industry_observations())

    def event_rows(self) -> DataFrame:
        """Watchlist rows with their catalyst, forward returns and each group they are in."""
        watch = self.stock_scores().filter(f"rank <= {C.WATCHLIST}").select("score_date", "symbol", "sector", *AHEAD).join(self.status(), ["score_date", "symbol"])
        return with_forward(watch, self.fwd, self.funds).selectExpr("*", f"explode(split({EVENT_GROUPS}, '[|]')) AS grp")

    def action_rows(self) -> DataFrame:
        watch = self.actions().filter(f"rank <= {C.WATCHLIST}").selectExpr("score_date", "symbol", "sector", f"array_distinct(split({ACTION_GROUPS}, '[|]')) AS groups".replace("primary_", "primary"), *AHEAD)
        return with_forward(watch, self.fwd, self.funds).selectExpr("*", "explode(groups) AS grp")

    def active_flags(self) -> DataFrame:
        """(score_date, flag) of every active macro flag."""
        return self.flags().filter("flags <> ''").selectExpr("score_date", "explode(split(flags, '[|]')) AS flag")

    def leadership(self) -> DataFrame:
        rows = self.active_flags().join(self.sectors().select("score_date", "sector", "rank", "score"), "score_date")
        return rows.groupBy("flag", "sector").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") == 1).alias("top_rank_count"), F.avg("rank").alias("avg_rank"), F.avg("score").alias("avg_score"))


_HAS = lambda p: f"catalyst LIKE '%{p}:%'"
_KINDS = "(" + " + ".join(f"CASE WHEN {_HAS(p)} THEN 1 ELSE 0 END" for p in ("recent_news", "earnings", "filing")) + ")"
EVENT_GROUPS = f"concat_ws('|', 'all_watchlist', CASE WHEN catalyst = '{C.PENDING}' THEN 'pending_source' ELSE 'event_context' END, CASE WHEN {_HAS('recent_news')} THEN 'recent_news' END, CASE WHEN {_HAS('earnings')} THEN 'earnings' END, CASE WHEN {_HAS('filing')} THEN 'filing' END, CASE WHEN {_HAS('earnings')} OR {_HAS('filing')} THEN 'event_risk' END, CASE WHEN {_KINDS} >= 2 THEN 'multiple_event_types' END)"
ACTION_GROUPS = "concat_ws('|', 'all_watchlist', primary_, labels)"

cte("x_sector_fwd", "SELECT s.*, u.horizon, u.fund_ret AS ret, u.fund_ret - u.spy_ret AS relative, u.fund_ret - u.spy_ret AS vs_spy, CAST(NULL AS DOUBLE) AS vs_sector FROM x_sectors s JOIN x_fund_fwd u ON u.score_date = s.score_date AND u.sector = s.sector")
_COLS = ", ".join(OBSERVED)
cte("x_sector_dec", f"SELECT score_date, sector, 'sector' AS entity, {decile('score', 'score_date', 'rank')} AS decile FROM x_sectors")
cte("x_comp_long", "SELECT score_date, sector, rank, unnest([" + ", ".join(f"'sector_component_{k}'" for k in COMPONENTS) + "]) AS entity, unnest([" + ", ".join(f"CAST({c} AS DOUBLE)" for c in COMPONENTS.values()) + "]) AS value FROM x_sectors")
cte("x_comp_dec", f"SELECT score_date, sector, entity, {decile('value', 'score_date, entity', 'rank')} AS decile FROM x_comp_long")
cte("x_obs_sector", "SELECT d.entity, s.score_date, s.horizon, d.decile, s.ret, s.relative, s.vs_spy, s.vs_sector FROM x_sector_fwd s JOIN x_sector_dec d ON d.score_date = s.score_date AND d.sector = s.sector")
cte("x_obs_comp", "SELECT d.entity, s.score_date, s.horizon, d.decile, s.ret, s.relative, s.vs_spy, s.vs_sector FROM x_sector_fwd s JOIN x_comp_dec d ON d.score_date = s.score_date AND d.sector = s.sector")
cte("x_stock_dec", f"SELECT score_date, symbol, sector, 'stock' AS entity, {decile('score', 'score_date', 'rank')} AS decile FROM x_stocks")
cte("x_obs_stock", f"SELECT entity, score_date, horizon, decile, ret, vs_sector AS relative, vs_spy, vs_sector FROM ({_JOINED.format(rows='x_stock_dec')})")
cte("x_ind_dec", f"SELECT score_date, sector, industry, {decile('score', 'score_date', 'rank')} AS decile FROM x_industries")
cte("x_stock_ind", "SELECT s.score_date, s.symbol, s.sector, 'stock_by_industry' AS entity, d.decile FROM x_stocks s JOIN x_ind_dec d ON d.score_date = s.score_date AND d.sector = s.sector AND d.industry = s.industry")
cte("x_obs_ind", f"SELECT entity, score_date, horizon, decile, ret, vs_sector AS relative, vs_spy, vs_sector FROM ({_JOINED.format(rows='x_stock_ind')})")
cte("x_obs", " UNION ALL ".join(f"SELECT {_COLS} FROM x_obs_{k}" for k in ("sector", "comp", "stock", "ind")))
cte("x_watch_events", "SELECT t.score_date, t.symbol, t.sector, c.catalyst FROM x_top t JOIN x_catalysts c USING (score_date, symbol)")
cte("x_event_rows", f"SELECT *, unnest(string_split({EVENT_GROUPS}, '|')) AS grp FROM ({_JOINED.format(rows='x_watch_events')})")
cte("x_watch_actions", f"SELECT score_date, symbol, sector, list_distinct(string_split({ACTION_GROUPS}, '|')) AS groups FROM x_action WHERE rank <= {C.WATCHLIST}")
cte("x_action_rows", f"SELECT *, unnest(groups) AS grp FROM ({_JOINED.format(rows='x_watch_actions')})")
cte("x_active", "SELECT score_date, unnest(string_split(flags, '|')) AS flag FROM x_flags WHERE flags <> ''")
cte("x_leadership", "SELECT flag, sector, count(*) AS n, count(*) FILTER (WHERE rank = 1) AS top_rank_count, avg(rank) AS avg_rank, avg(score) AS avg_score FROM x_active JOIN x_sectors USING (score_date) GROUP BY flag, sector")

_NULL = lambda x, k: r6(f"coalesce({x}, -9.0)", k)


def _summary(by: str, hit: str, measures: tuple[str, ...]) -> list[str]:
    return [*by.split(", "), "count(*) AS n", r6(f"avg(CASE WHEN {hit} > 0 THEN 1e0 ELSE 0e0 END)", "hit_rate"), *(_NULL(f"avg({m})", f"mean_{m}") for m in measures), *(_NULL(f"median({m})", f"median_{m}") for m in measures)]


def grouped(df: DataFrame, by: str, hit: str, measures: tuple[str, ...]) -> DataFrame:
    names = by.split(", ")
    exprs = [F.expr(x) for x in _summary(by, hit, measures)[len(names) :]]
    return df.groupBy(*names).agg(*exprs)


LEAD = r6("avg_rank"), r6("avg_score")
_FLAG_DIM = ", ".join(f"'{k}'" for k in C.MACRO_FLAGS)


def _freshness(m: Tested) -> DataFrame:
    spark = m.bars.sparkSession
    names = spark.range(1).selectExpr("inline(array(" + ", ".join(f"named_struct('series', '{s}')" for s, _ in C.MACRO_SERIES) + "))")
    dates = m.dates.agg(F.count(F.lit(1)).alias("dates"))
    seen = m.macro().groupBy("series").agg(F.count(F.lit(1)).alias("covered"), F.count_if("stale").alias("n_stale"), F.avg("age").alias("mean_age"), F.max("age").alias("max_age"), F.max("date").alias("latest"))
    return names.join(F.broadcast(dates)).join(seen, "series", "left").selectExpr("series", "coalesce(covered, 0) AS covered", "dates - coalesce(covered, 0) AS missing", "coalesce(n_stale, 0) AS n_stale", _NULL("mean_age", "mean_age"), "coalesce(max_age, -1) AS max_age", "latest")


def _flag_summary(m: Tested) -> DataFrame:
    rows = m.flags().join(m.regime().select("score_date", "score", "base_label"), "score_date")
    parts = ", ".join(f"named_struct('flag', '{k}', 'active', {k})" for k in C.MACRO_FLAGS)
    long = rows.selectExpr("score", "base_label", f"inline(array({parts}))")
    return long.groupBy("flag").agg(F.count_if("active").alias("n_active"), F.expr(r6("avg(CASE WHEN active THEN 1e0 ELSE 0e0 END)", "share")), F.expr(_NULL("avg(CASE WHEN active THEN score END)", "mean_score")), F.expr("count_if(active AND base_label = 'Risk-on') AS n_risk_on"), F.expr("count_if(active AND base_label IN ('Defensive', 'Mixed')) AS n_defensive_mixed"))


_COUNTERS = {
    "snapshots": "true",
    "complete": f"n_series = {len(C.MACRO_SERIES)}",
    "missing": f"n_series < {len(C.MACRO_SERIES)}",
    "stale": "n_stale > 0",
    "risk_on_with_stress": "base_label = 'Risk-on' AND flags <> ''",
    "defensive_with_none": "base_label IN ('Defensive', 'Mixed') AND flags = ''",
}
_COUNTED = ", ".join(f"count(CASE WHEN {x} THEN 1 END) AS {k}" for k, x in _COUNTERS.items())
_DISAGREE = f"({_COUNTERS['risk_on_with_stress']} OR {_COUNTERS['defensive_with_none']})"
cte("x_flag_regime", "SELECT f.*, g.score, g.base_label FROM x_flags f JOIN x_regime g USING (score_date)")
_regimes = lambda m: m.flags().join(m.regime().select("score_date", "score", "base_label"), "score_date")
_TOP5 = "row_number() OVER (PARTITION BY flag ORDER BY top_rank_count DESC, floor(avg_rank * 1e8 + 0.50001), floor(avg_score * 1e8 + 0.50001) DESC, sector)"
_OBS = ["entity", "score_date", "horizon", "decile", r6("ret"), r6("relative"), r6("vs_spy"), _NULL("vs_sector", "vs_sector")]

_ROWS = {
    "r03_sector_deciles": (lambda m: m.sector_observations(), "x_obs_sector", _OBS),
    "r04_component_deciles": (lambda m: m.component_observations(), "x_obs_comp", _OBS),
    "j06_stock_observations": (lambda m: m.stock_observations(), "x_obs_stock", _OBS),
    "j08_industry_observations": (lambda m: m.industry_observations(), "x_obs_ind", _OBS),
    "a13_sector_leadership": (lambda m: m.leadership(), "x_leadership", ["flag", "sector", "n", "top_rank_count", *LEAD]),
    "r12_flag_top5": (lambda m: m.leadership().selectExpr("*", f"CAST({_TOP5} AS INT) AS place").filter("place <= 5"), f"(SELECT * FROM (SELECT *, CAST({_TOP5} AS INT) AS place FROM x_leadership) WHERE place <= 5)", ["flag", "sector", "place", *LEAD]),
    "r13_disagreements": (lambda m: _regimes(m).filter(_DISAGREE).orderBy("score_date").limit(10), f"(SELECT * FROM x_flag_regime WHERE {_DISAGREE} ORDER BY score_date LIMIT 10)", ["score_date", "base_label", "flags", r6("score")]),
}
_GROUPED = {
    "q20_backtest": (lambda m: m.observations(), "x_obs", "entity, horizon, decile", "relative", MEASURES),
    "q21_event_context": (lambda m: m.event_rows(), "x_event_rows", "grp, horizon", "vs_sector", ("ret", "vs_sector", "vs_spy")),
    "q22_actionability": (lambda m: m.action_rows(), "x_action_rows", "grp, horizon", "vs_sector", ("ret", "vs_sector", "vs_spy")),
}
_WHOLE = {
    "a11_series_freshness": (_freshness, "SELECT n.series, count(a.score_date) AS covered, (SELECT count(*) FROM x_dates) - count(a.score_date) AS missing, count(*) FILTER (WHERE stale) AS n_stale, " + _NULL("avg(age)", "mean_age") + ", coalesce(max(age), -1) AS max_age, max(a.date) AS latest FROM x_series_names n LEFT JOIN x_macro_asof a ON a.series = n.series GROUP BY n.series"),
    "a12_flag_summary": (_flag_summary, "SELECT flag, count(*) FILTER (WHERE active) AS n_active, " + r6("avg(CASE WHEN active THEN 1e0 ELSE 0e0 END)", "share") + ", " + _NULL("avg(CASE WHEN active THEN score END)", "mean_score") + ", count(*) FILTER (WHERE active AND base_label = 'Risk-on') AS n_risk_on, count(*) FILTER (WHERE active AND base_label IN ('Defensive', 'Mixed')) AS n_defensive_mixed FROM (SELECT score, base_label, unnest([" + _FLAG_DIM + "]) AS flag, unnest([" + ", ".join(C.MACRO_FLAGS) + "]) AS active FROM x_flag_regime) GROUP BY flag"),
    "a14_macro_counters": (lambda m: _regimes(m).agg(*(F.expr(x) for x in _COUNTED.split(", count")[:1]), *(F.expr("count" + x) for x in _COUNTED.split(", count")[1:])), f"SELECT {_COUNTED} FROM x_flag_regime"),
}


def _run_rows(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    build, _, columns = _ROWS[key]
    return build(Tested(spark, sf_dir)).selectExpr(*columns)


def _run_grouped(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    build, _, by, hit, measures = _GROUPED[key]
    return grouped(build(Tested(spark, sf_dir)), by, hit, measures)


def _run_whole(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _WHOLE[key][0](Tested(spark, sf_dir))


QUERIES = {k: partial(_run_rows, k) for k in _ROWS} | {k: partial(_run_grouped, k) for k in _GROUPED} | {k: partial(_run_whole, k) for k in _WHOLE}
ORACLE = {k: with_(f"SELECT {', '.join(c)} FROM {source}") for k, (_, source, c) in _ROWS.items()}
ORACLE |= {k: with_(f"SELECT {', '.join(_summary(by, hit, ms))} FROM {source} GROUP BY {by}") for k, (_, source, by, hit, ms) in _GROUPED.items()}
ORACLE |= {k: with_(sql) for k, (_, sql) in _WHOLE.items()}
