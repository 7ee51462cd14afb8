"""Catalyst status, actionability and watchlist labels, macro context."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel import config as C
from tidewheel.functions.expressions import r6
from tidewheel.operators.oracle import cte, with_
from tidewheel.plans.scores import Market
from tidewheel.sources.adapter import macro_series, market_events

NEWS_DAYS, FILING_DAYS = 7, 14

# ---- catalysts ------------------------------------------------------------------

CATALYST = "CASE WHEN n_news = 0 AND next_earnings IS NULL AND form IS NULL THEN 'pending_source' ELSE concat_ws(' | ', CASE WHEN n_news > 0 THEN concat('recent_news:', CAST(n_news AS STRING)) END, CASE WHEN next_earnings IS NOT NULL THEN concat('earnings:', CAST(next_earnings AS STRING)) END, CASE WHEN form IS NOT NULL THEN concat('filing:', form) END) END"


#: Days of a score date on which an event counts, from and to, and how many they are.
SPANS = {"news": (f"date_sub(score_date, {NEWS_DAYS})", "score_date", NEWS_DAYS + 1), "filing": (f"date_sub(score_date, {FILING_DAYS})", "score_date", FILING_DAYS + 1), "earnings": ("score_date", "date_add(score_date, 30)", 31)}


def asked(stocks: DataFrame) -> DataFrame:
    """(score_date, symbol, event_type, cell, from_, to_): the spans of the rows of stocks, by cells of as many days as a span has, of which it meets two at most."""
    spans = "array(" + ", ".join(f"named_struct('event_type', '{t}', 'days', {n}, 'from_', {a}, 'to_', {b})" for t, (a, b, n) in SPANS.items()) + ")"
    return stocks.selectExpr("score_date", "symbol", f"inline({spans})").selectExpr("score_date", "symbol", "event_type", "from_", "to_", "explode(sequence(unix_date(from_) div days, unix_date(to_) div days)) AS cell")


def catalysts(stocks: DataFrame, events: DataFrame) -> DataFrame:
    """(score_date, symbol, catalyst) of the rows of stocks.

    An event counts on the dates near it: news for a week, filings for two, an
    earnings date on the month before it. A row of stocks, of which each date has
    a few, is repeated for the cells of those days, and each event lies in one cell,
    so they meet by equality. Both are shuffled: Spark takes the repeated rows for as
    small as the rows and would gather them in the driver.
    """
    cell = "CASE event_type " + " ".join(f"WHEN '{t}' THEN unix_date(date) div {n}" for t, (_, _, n) in SPANS.items()) + " END AS cell"
    seen = events.selectExpr("event_id", "symbol", "event_type", "CASE WHEN event_type = 'filing' THEN headline END AS headline", "date AS event_date", cell)
    met = asked(stocks).hint("shuffle_hash").join(seen, ["symbol", "event_type", "cell"]).filter("event_date BETWEEN from_ AND to_")
    latest = F.max(F.when(F.col("event_type") == "filing", F.struct("event_date", "event_id", "headline")))
    counted = met.groupBy("score_date", "symbol").agg(F.count_if(F.col("event_type") == "news").alias("n_news"), F.min(F.when(F.col("event_type") == "earnings", F.col("event_date"))).alias("next_earnings"), latest.alias("l"))
    status = counted.selectExpr("score_date", "symbol", "n_news", "next_earnings", "element_at(split(trim(l.headline), ' +'), 1) AS form").selectExpr("score_date", "symbol", f"{CATALYST} AS catalyst")
    return stocks.select("score_date", "symbol").join(status, ["score_date", "symbol"], "left").select("score_date", "symbol", F.coalesce("catalyst", F.lit(C.PENDING)).alias("catalyst"))


cte(
    "x_catalysts",
    f"""SELECT s.score_date, s.symbol, coalesce(c.catalyst, '{C.PENDING}') AS catalyst FROM x_stocks s LEFT JOIN (
  SELECT score_date, symbol, {CATALYST.replace(' AS STRING', ' AS VARCHAR')} AS catalyst FROM (
    SELECT s.score_date, s.symbol, count(*) FILTER (WHERE event_type = 'news') AS n_news, min(e.date) FILTER (WHERE event_type = 'earnings') AS next_earnings,
      split_part(arg_max(e.headline, (epoch(e.date) * 1000000 + e.event_id)) FILTER (WHERE event_type = 'filing'), ' ', 1) AS form
    FROM x_stocks s JOIN x_events e ON e.symbol = s.symbol AND
      CASE event_type WHEN 'news' THEN s.score_date BETWEEN e.date AND e.date + {NEWS_DAYS} WHEN 'filing' THEN s.score_date BETWEEN e.date AND e.date + {FILING_DAYS} ELSE s.score_date BETWEEN e.date - 30 AND e.date END
    GROUP BY s.score_date, s.symbol)) c USING (score_date, symbol)""",
)

# ---- actionability --------------------------------------------------------------

LEADER = "(rel_sector > 0 OR rel_spy > 0)"
EXTENDED = "(r5 >= 0.08 OR r1 >= 0.05 OR gap0 >= 0.04 OR dist20 >= 0.12 OR dist50 >= 0.20 OR atr_ext20 >= 2.5)"
NEAR = "(abs(dist20) <= 0.04 OR abs(dist50) <= 0.06)"
CONDITIONS = {
    "extended_leader": EXTENDED,
    "pullback_leader": f"NOT {EXTENDED} AND {LEADER} AND dist20high >= -0.12 AND dist20high <= -0.03 AND trend_state IN ('above_20d_50d', 'above_20d') AND {NEAR}",
    "base_compression_candidate": f"NOT {EXTENDED} AND {LEADER} AND range10 <= 0.08 AND dist20high >= -0.03",
    "early_rotation_candidate": f"NOT {EXTENDED} AND {LEADER} AND r5 > 0 AND r5 < 0.08 AND ({NEAR} OR (dist20 >= -0.02 AND dist20 <= 0.08))",
    "actionable_leader": f"NOT {EXTENDED} AND (score >= 70 OR sector_score >= 70) AND {LEADER} AND trend_state = 'above_20d_50d' AND dist20 < 0.12 AND dist50 < 0.20 AND atr_ext20 < 2.5",
}
FLAGS = {k: f"coalesce(complete, false) AND coalesce({x}, false)" for k, x in CONDITIONS.items()}
_NONE = " AND ".join(f"NOT {k}" for k in list(CONDITIONS)[1:])
EVENT_WATCH = f"catalyst <> '{C.PENDING}' AND {_NONE}"
LABELS = "concat_ws('|', " + ", ".join(f"CASE WHEN {k} THEN '{k}' END" for k in [*CONDITIONS, "event_watch_unconfirmed"]) + ")"
ACTION = "CASE WHEN found = '' THEN 'unclassified_leader' ELSE found END"
PRIMARY = "CASE " + " ".join(f"WHEN {k} THEN '{k}'" for k in C.PRIMARY_ORDER[:-1]) + " ELSE 'unclassified_leader' END"


def actionability(stocks: DataFrame, status: DataFrame) -> DataFrame:
    """stocks with catalyst, one boolean a label, labels (joined by |) and primary."""
    out = stocks.join(status, ["score_date", "symbol"]).selectExpr("*", *(f"{x} AS {k}" for k, x in FLAGS.items())).selectExpr("*", f"{EVENT_WATCH} AS event_watch_unconfirmed")
    return out.selectExpr("*", f"{LABELS} AS found", f"{PRIMARY} AS primary").selectExpr("*", f"{ACTION} AS labels").drop("found")


cte("x_action1", "SELECT s.*, c.catalyst, " + ", ".join(f"{x} AS {k}" for k, x in FLAGS.items()) + " FROM x_stocks s JOIN x_catalysts c USING (score_date, symbol)")
cte("x_action2", f"SELECT *, {EVENT_WATCH} AS event_watch_unconfirmed FROM x_action1")
cte("x_action3", f"SELECT *, {LABELS} AS found, {PRIMARY} AS primary_ FROM x_action2")
cte("x_action", f"SELECT *, {ACTION} AS labels FROM x_action3")

# ---- macro ----------------------------------------------------------------------

STALE_DAYS = "CASE frequency WHEN 'Monthly' THEN 45 WHEN 'Weekly' THEN 14 ELSE 7 END"
_v = lambda s: f"max(CASE WHEN series = '{s}' THEN value END)"
_p = lambda s: f"max(CASE WHEN series = '{s}' THEN prev END)"
MACRO_FLAGS = {
    "volatility_stress": f"{_v('VIXCLS')} >= 20",
    "rate_pressure": f"{_v('DGS10')} > {_p('DGS10')}",
    "yield_curve_inversion": f"{_v('T10Y2Y')} < 0",
    "credit_stress": f"{_v('BAMLC0A0CM')} > {_p('BAMLC0A0CM')}",
    "dollar_pressure": f"{_v('DTWEXBGS')} > {_p('DTWEXBGS')}",
    "liquidity_tightening": f"{_v('WALCL')} < {_p('WALCL')}",
    "inflation_pressure": f"{_v('CPIAUCSL')} / nullif(max(CASE WHEN series = 'CPIAUCSL' THEN year_ago END), 0) - 1 >= 0.03",
    "labor_cooling": f"coalesce({_v('UNRATE')} > {_p('UNRATE')}, false) OR coalesce({_v('PAYEMS')} < {_p('PAYEMS')}, false)",
}
MACRO_TEXT = "concat_ws('|', " + ", ".join(f"CASE WHEN {k} THEN '{k}' END" for k in C.MACRO_FLAGS) + ")"


def macro_asof(series: DataFrame, dates: DataFrame) -> DataFrame:
    """(score_date, series, frequency, date, value, prev, year_ago, age, stale): the last observation at every date.

    Like bars, an observation holds until its successor; the days it holds are
    matched with the dates.
    """
    by = "OVER (PARTITION BY series ORDER BY date)"
    seen = series.selectExpr("*", f"lag(value, 1) {by} AS prev", f"lag(value, 12) {by} AS year_ago", f"lead(date, 1) {by} AS next_date")
    span = dates.agg(F.min("score_date").alias("d0"), F.max("score_date").alias("d1"))
    held = seen.crossJoin(F.broadcast(span)).withColumn("from_", F.greatest("date", "d0")).withColumn("to_", F.least(F.coalesce(F.date_sub("next_date", 1), F.col("d1")), F.col("d1"))).filter("from_ <= to_")
    out = held.withColumn("score_date", F.explode(F.sequence("from_", "to_"))).join(dates, "score_date")
    return out.select("score_date", "series", "frequency", "date", "value", "prev", "year_ago", F.datediff("score_date", "date").cast("long").alias("age")).withColumn("stale", F.expr(f"age > {STALE_DAYS}"))


def macro_flags(asof: DataFrame, dates: DataFrame) -> DataFrame:
    """One row a date: the eight flags, flags (joined by |), n_series, n_stale."""
    flags = asof.groupBy("score_date").agg(*(F.coalesce(F.expr(x), F.lit(False)).alias(k) for k, x in MACRO_FLAGS.items()), F.count(F.lit(1)).alias("n_series"), F.count_if("stale").alias("n_stale"))
    out = dates.join(flags, "score_date", "left").na.fill(False, list(C.MACRO_FLAGS)).na.fill(0, ["n_series", "n_stale"])
    return out.withColumn("flags", F.expr(MACRO_TEXT))


cte("x_macro_seen", "SELECT *, lag(value, 1) OVER w AS prev, lag(value, 12) OVER w AS year_ago FROM x_macro WINDOW w AS (PARTITION BY series ORDER BY date)")
cte("x_macro_asof1", "SELECT p.score_date, m.*, CAST(p.score_date - m.date AS BIGINT) AS age FROM (SELECT score_date, series AS sid FROM x_dates CROSS JOIN x_series_names) p ASOF JOIN x_macro_seen m ON p.sid = m.series AND p.score_date >= m.date")
cte("x_macro_asof", f"SELECT *, age > {STALE_DAYS} AS stale FROM x_macro_asof1")
cte("x_flags1", "SELECT score_date, " + ", ".join(f"coalesce({x}, false) AS {k}" for k, x in MACRO_FLAGS.items()) + ", count(*) AS n_series, count(*) FILTER (WHERE stale) AS n_stale FROM x_macro_asof GROUP BY score_date")
cte("x_flags2", "SELECT d.score_date, " + ", ".join(f"coalesce({k}, false) AS {k}" for k in MACRO_FLAGS) + ", coalesce(n_series, 0) AS n_series, coalesce(n_stale, 0) AS n_stale FROM x_dates d LEFT JOIN x_flags1 USING (score_date)")
cte("x_flags", f"SELECT *, {MACRO_TEXT} AS flags FROM x_flags2")

# ---- watchlist ------------------------------------------------------------------

_LOW = "replace(lower(regime), '-', '_')"
MACRO_CONFLICT = f"(({_LOW} LIKE '%risk_on%' AND flags <> '') OR (({_LOW} LIKE '%defensive%' OR {_LOW} LIKE '%mixed%' OR {_LOW} LIKE '%risk_off%') AND flags = ''))"
WATCH_LABELS = {
    "sector_leader": "sector_rank <= 3",
    "industry_leader": "industry_rank <= 10",
    "relative_strength_leader": "rel_sector > 0 AND rel_spy > 0",
    "volume_confirmed": "rel_volume >= 1.2",
    "new_leader": "has_previous AND NOT in_previous",
    "event_context": f"catalyst <> '{C.PENDING}'",
    "event_risk": "catalyst LIKE '%earnings:%' OR catalyst LIKE '%filing:%'",
    "macro_conflict_context": MACRO_CONFLICT,
}
WATCH_TEXT = "concat_ws('|', " + ", ".join(f"CASE WHEN {x} THEN '{k}' END" for k, x in WATCH_LABELS.items()) + ")"


def previous_dates(dates: DataFrame) -> DataFrame:
    """(score_date, next_score_date): dates are one row a trading day, a single small window."""
    return dates.selectExpr("score_date", "lead(score_date, 1) OVER (ORDER BY score_date) AS next_score_date").filter("next_score_date IS NOT NULL")


def watchlist(stocks: DataFrame, sectors: DataFrame, industries: DataFrame, status: DataFrame, regime: DataFrame, flags: DataFrame, dates: DataFrame) -> DataFrame:
    """The best WATCHLIST stocks of each date with their labels."""
    top = stocks.filter(F.col("rank") <= C.WATCHLIST)
    before = top.select("score_date", "symbol").join(F.broadcast(previous_dates(dates)), "score_date").select(F.col("next_score_date").alias("score_date"), "symbol", F.lit(True).alias("in_previous"))
    some = before.select("score_date", F.lit(True).alias("has_previous")).distinct()
    out = top.join(status, ["score_date", "symbol"]).join(before, ["score_date", "symbol"], "left").join(some, "score_date", "left").na.fill(False, ["in_previous", "has_previous"])
    out = out.join(sectors.select("score_date", "sector", F.col("rank").alias("sector_rank")), ["score_date", "sector"]).join(industries.select("score_date", "sector", "industry", F.col("rank").alias("industry_rank")), ["score_date", "sector", "industry"], "left")
    out = out.join(regime.select("score_date", F.col("label").alias("regime")), "score_date").join(flags.select("score_date", "flags"), "score_date")
    return out.withColumn("labels", F.expr(WATCH_TEXT))


cte("x_top", f"SELECT * FROM x_stocks WHERE rank <= {C.WATCHLIST}")
# one join a step: a symbol was on the list before if its last day on it is the score date before
cte("x_watch_days", "SELECT d.score_date, d.before, coalesce(d.before IN (SELECT score_date FROM x_top), false) AS has_previous, g.label AS regime, f.flags FROM (SELECT score_date, lag(score_date) OVER (ORDER BY score_date) AS before FROM x_dates) d JOIN x_regime g ON g.score_date = d.score_date JOIN x_flags f ON f.score_date = d.score_date")
cte("x_watch_a", "SELECT t.*, lag(score_date) OVER (PARTITION BY symbol ORDER BY score_date) AS last_day, c.catalyst FROM x_top t JOIN x_catalysts c USING (score_date, symbol)")
cte("x_watch_b", "SELECT a.*, s.rank AS sector_rank FROM x_watch_a a JOIN x_sectors s ON s.score_date = a.score_date AND s.sector = a.sector")
cte("x_watch_c", "SELECT b.*, i.rank AS industry_rank FROM x_watch_b b LEFT JOIN x_industries i ON i.score_date = b.score_date AND i.sector = b.sector AND i.industry = b.industry")
cte("x_watch1", "SELECT c.*, d.has_previous, coalesce(c.last_day = d.before, false) AS in_previous, d.regime, d.flags FROM x_watch_c c JOIN x_watch_days d ON d.score_date = c.score_date")
cte("x_watch", f"SELECT *, {WATCH_TEXT} AS labels FROM x_watch1")


class Labelled(Market):
    """A Market with events and macro series."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark, sf_dir)
        self.events, self.series = market_events(spark, sf_dir), macro_series(spark, sf_dir)

    def status(self) -> DataFrame:
        return self.table("catalysts", self._status)

    def actions(self) -> DataFrame:
        return self.table("actionability", self._actions)

    def macro(self) -> DataFrame:
        return self.table("macro_asof", self._macro)

    def flags(self) -> DataFrame:
        return self.table("macro_flags", self._flags)

    def watch(self) -> DataFrame:
        return self.table("watchlists", self._watch)

    def _status(self) -> DataFrame:
        return catalysts(self.stock_scores(), self.events)

    def _actions(self) -> DataFrame:
        return actionability(self.stock_scores(), self.status())

    def _macro(self) -> DataFrame:
        return macro_asof(self.series, self.dates)

    def _flags(self) -> DataFrame:
        return macro_flags(self.macro(), self.dates)

    def _watch(self) -> DataFrame:
        return watchlist(self.stock_scores(), self.sectors(), self.industries(), self.status(), self.regime(), self.flags(), self.dates)


_OUT = {
    "a18_catalyst_status": (lambda m: m.status(), "x_catalysts", ["score_date", "symbol", "catalyst"]),
    "q10_actionability": (lambda m: m.actions().withColumnRenamed("primary", "primary_"), "x_action", ["score_date", "symbol", "primary_ AS primary_label", "labels"]),
    "r10_review_queue": (lambda m: m.actions().withColumnRenamed("primary", "primary_").selectExpr("*", "CAST(array_position(array(" + ", ".join(f"'{x}'" for x in C.REVIEW_ORDER) + "), primary_) AS INT) AS bucket").selectExpr("*", "CAST(row_number() OVER (PARTITION BY score_date ORDER BY bucket, rank) AS INT) AS place"), "(SELECT *, CAST(row_number() OVER (PARTITION BY score_date ORDER BY bucket, rank) AS INT) AS place FROM (SELECT *, CAST(list_position([" + ", ".join(f"'{x}'" for x in C.REVIEW_ORDER) + "], primary_) AS INT) AS bucket FROM x_action))", ["score_date", "symbol", "bucket", "place"]),
    "a21_bucket_counts": (lambda m: m.actions().withColumnRenamed("primary", "primary_").groupBy("score_date", "primary_").agg(F.count(F.lit(1)).alias("n"), F.min_by("symbol", "rank").alias("lead_")), "(SELECT score_date, primary_, count(*) AS n, arg_min(symbol, rank) AS lead_ FROM x_action GROUP BY score_date, primary_)", ["score_date", "primary_ AS bucket", "n", "lead_ AS lead_symbol"]),
    "j03_macro_asof": (lambda m: m.macro(), "x_macro_asof", ["score_date", "series", "date", "age", "stale", r6("value"), r6("coalesce(prev, -9.0)", "prev"), r6("coalesce(year_ago, -9.0)", "year_ago")]),
    "q16_macro_flags": (lambda m: m.flags(), "x_flags", ["score_date", "flags", "n_series", "n_stale"]),
    "q14_watchlist_labels": (lambda m: m.watch(), "x_watch", ["score_date", "rank", "symbol", "labels"]),
    "j10_new_leaders": (lambda m: m.watch().filter("has_previous AND NOT in_previous"), "(SELECT * FROM x_watch WHERE has_previous AND NOT in_previous)", ["score_date", "symbol", "rank"]),
    "q15_macro_conflict": (lambda m: m.regime().withColumnRenamed("label", "regime").join(m.flags(), "score_date"), "(SELECT g.score_date, g.label AS regime, f.flags FROM x_regime g JOIN x_flags f USING (score_date))", ["score_date", "regime", "flags", f"{MACRO_CONFLICT} AS conflict"]),
}


def _run(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    build, _, columns = _OUT[key]
    return build(Labelled(spark, sf_dir)).selectExpr(*columns)


QUERIES = {k: partial(_run, k) for k in _OUT}
ORACLE = {k: with_(f"SELECT {', '.join(columns)} FROM {source}") for k, (_, source, columns) in _OUT.items()}
