"""The intraday funnel by session: every symbol, day and timeframe is its own, and daily measures are those of its day.

All days run at once where a run takes one: a day's stocks are placed among each
other, profiles and triggers never see another day's bars, and levels come from
the last daily bar on or before the day.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.expressions import r6, range_bars, timeframe_minutes
from tidewheel.operators.asof import effective
from tidewheel.operators.features import bars, recent_prices
from tidewheel.operators.oracle import cte, with_
from tidewheel.plans import intraday as I
from tidewheel.plans.scores import Market
from tidewheel.sources.adapter import EVENT_SHIFT_DAYS, read, stock_prices, stock_symbol

SESSION = ("symbol", "date", "timeframe")
#: Profiles are built of one timeframe and triggers searched in another.
PROFILE, TRIGGER = "1Hour", "30Min"
TIMEFRAMES = (PROFILE, TRIGGER)
RANGES = {t: range_bars(I.RANGE_MINUTES, t) for t in TIMEFRAMES}
_SECONDS = "CASE timeframe " + " ".join(f"WHEN '{t}' THEN {60 * timeframe_minutes(t)}" for t in TIMEFRAMES) + " END"


def ema_at(bars: DataFrame, days: DataFrame) -> DataFrame:
    """(symbol, date, ema10, ema20) at the bars that are in effect on the days: means of the first n closes, then recursive.

    A symbol's closes are one array, as many as it has trading days. Those before
    the first bar asked for are only averaged; the few from there on keep theirs.
    Of a bar only its date and close are read, so nothing is sorted but the arrays.
    """
    span = days.agg(F.min("score_date").alias("d0"), F.max("score_date").alias("d1"))
    listed = bars.select("symbol", "date", "ac").crossJoin(F.broadcast(span)).filter("date <= d1")  # one row
    after = listed.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("date", "ac"))).alias("a"), F.count_if(F.expr("date > d0")).alias("n"))
    # the last bar up to the first day and those after it
    arrays = after.selectExpr("symbol", "a", "slice(a, greatest(size(a) - CAST(n AS INT), 1), size(a)) AS w")
    split = arrays.selectExpr("symbol", "w", "transform(slice(a, 1, size(a) - size(w)), e -> e.ac) AS a")
    before = lambda n: f"CASE WHEN size(a) < {n} THEN aggregate(a, 0D, (s, x) -> s + x) ELSE aggregate(slice(a, {n + 1}, size(a) - {n}), aggregate(slice(a, 1, {n}), 0D, (s, x) -> s + x) / {n}, (s, x) -> x * {2 / (n + 1)!r}D + s * {1 - 2 / (n + 1)!r}D) END"  # noqa: E731  the sum, until there are n closes
    ema = lambda n: f"CASE WHEN s.n + 1 < {n} THEN s.m{n} + x.ac WHEN s.n + 1 = {n} THEN (s.m{n} + x.ac) / {n} ELSE x.ac * {2 / (n + 1)!r}D + s.m{n} * {1 - 2 / (n + 1)!r}D END"
    step = f"named_struct('n', s.n + 1, 'm10', {ema(10)}, 'm20', {ema(20)}, 'out', s.out)"
    kept = "concat(s.out, array(named_struct('date', x.date, 'ema10', CASE WHEN s.n >= 10 THEN s.m10 END, 'ema20', CASE WHEN s.n >= 20 THEN s.m20 END)))"
    walked = f"aggregate(w, named_struct('n', size(a), 'm10', {before(10)}, 'm20', {before(20)}, 'out', CAST(array() AS array<struct<date: date, ema10: double, ema20: double>>)), (t, x) -> transform(array({step.replace('s.', 't.')}), s -> named_struct('n', s.n, 'm10', s.m10, 'm20', s.m20, 'out', {kept}))[0]).out"
    return split.selectExpr("symbol", f"inline({walked})")


@dataclass(frozen=True)
class Limits:
    """What a candidate of the first stage needs: a daily range, a relative volume, a place in the day's best share, one of the first `most`."""

    adr: float = I.MIN_ADR
    rvol: float = I.MIN_RVOL
    share: float = I.TOP_SHARE
    most: int = 25

    def meets(self) -> str:
        return f"adr20 > {self.adr} AND rv20 > {self.rvol} AND place <= greatest(1, ceil({self.share} * n))"

    def candidate(self) -> str:
        """meets(), up to `most` a day in the order of their places."""
        return f"{self.meets()} AND sum(CASE WHEN {self.meets()} THEN 1 ELSE 0 END) OVER (PARTITION BY date ORDER BY place ROWS UNBOUNDED PRECEDING) <= {self.most}"


#: The given tables' prices move by less than 1.5 % a day, so queries ask for less than the default.
CALM = Limits(adr=0.001, rvol=1.0, share=0.5)


class Sessions:
    """Session bars, first-stage measures, profiles, setups, triggers and readiness of all days with ticks."""

    def __init__(self, spark: SparkSession, sf_dir: str, limits: Limits = Limits()):  # noqa: B008  frozen
        self.spark, self.sf_dir, self.market, self.limits = spark, sf_dir, Market(spark, sf_dir), limits
        day = f"date_sub(CAST(ts AS DATE), {EVENT_SHIFT_DAYS})"
        self.days = self.market.table("session_days", lambda: read(spark, sf_dir, "events").selectExpr(f"{day} AS score_date").distinct())

    @cached_property
    def bars(self) -> DataFrame:
        return self.market.table("session_bars", self._bars)

    @cached_property
    def stage1(self) -> DataFrame:
        return self.market.table("session_stage1", self._stage1).selectExpr("*", f"{self.limits.candidate()} AS candidate")

    def _bars(self) -> DataFrame:
        """Bars of every session: (symbol, date, timeframe, slot, idx, n, open, high, low, close, volume, ac, atr20)."""
        suppliers = read(self.spark, self.sf_dir, "supplier").agg(F.count(F.lit(1)).alias("ns"))
        held = self.daily().select("symbol", "date", "ac", "atr20")  # merged: ticks then lie by symbol and day, and their bars need no shuffle of both timeframes
        ticks = read(self.spark, self.sf_dir, "events").crossJoin(F.broadcast(suppliers)).selectExpr(f"{stock_symbol('user_id % ns')} AS symbol", "event_id", f"date_sub(CAST(ts AS DATE), {EVENT_SHIFT_DAYS}) AS date", "CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000) AS BIGINT) % 86400 AS second", "value", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k")  # one row
        priced = ticks.join(held.hint("merge"), ["symbol", "date"]).withColumn("price", F.expr(I.PRICE)).withColumn("timeframe", F.explode(F.array(*map(F.lit, TIMEFRAMES))))
        slots = priced.withColumn("slot", F.expr(f"CAST(floor(second / ({_SECONDS})) AS INT)")).groupBy(*SESSION, "slot")
        made = slots.agg(F.min_by("price", "event_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "event_id").alias("close"), F.expr("CAST(sum(100 + 10 * k) AS DOUBLE)").alias("volume"), F.first("ac").alias("ac"), F.first("atr20").alias("atr20"))
        key = ", ".join(SESSION)
        return made.selectExpr("*", f"CAST(row_number() OVER (PARTITION BY {key} ORDER BY slot) - 1 AS INT) AS idx", f"CAST(count(*) OVER (PARTITION BY {key}) AS INT) AS n")

    def daily(self) -> DataFrame:
        """(symbol, date, bar_date, ac, STAGE1) of every stock and day: measures of the bar in effect, with or without nulls."""
        return self.market.table("session_daily", self._daily)

    def _daily(self) -> DataFrame:
        recent = bars(recent_prices(stock_prices(self.spark, self.sf_dir), self.days.agg(F.min("score_date").alias("since"))))
        held = effective(I.mansfield(recent, I.benchmark(self.market.etfs)), self.days).join(ema_at(self.market.stock_bars, self.days), ["symbol", "date"])
        return held.select("symbol", F.col("score_date").alias("date"), F.col("date").alias("bar_date"), "ac", *I.STAGE1)

    def _stage1(self) -> DataFrame:
        """Every stock's measures on every day and its place among the day's stocks."""
        rows = self.daily().join(self.market.stocks.select("symbol"), "symbol", "left_semi").filter(I._NO_NULL)
        return rows.selectExpr("*", *PLACE)

    def profiles(self) -> DataFrame:
        return I.volume_profile(self.bars, SESSION)

    def setups(self) -> DataFrame:
        """Sessions of the profile timeframe: latest price, confluence, and whether they pass the second stage."""
        last = self.bars.filter("idx = n - 1").select(*SESSION, F.col("close").alias("price"))
        levels = self.stage1.select("symbol", "date", "ema10", "ema20", "place", "candidate").join(self.profiles().filter(f"timeframe = '{PROFILE}'"), ["symbol", "date"])
        return levels.join(last, list(SESSION)).selectExpr(*SESSION, "place", "candidate", "poc", "val", "vwap", "ema10", "ema20", "price", f"{I.CONFLUENCE} AS confluence", f"{I.PASSES} AS stage2")

    def triggers(self, setups: DataFrame | None = None) -> DataFrame:
        """First triggers of the trigger timeframe's sessions, near the levels of the same day's profile."""
        levels = (self.setups() if setups is None else setups).select("symbol", "date", "poc", "val", "vwap", "ema10", "ema20")
        return I.triggers(self.bars.filter(f"timeframe = '{TRIGGER}'"), levels, SESSION, ("symbol", "date"), RANGES)

    def readiness(self) -> DataFrame:
        """One row for each day's candidate: how far it came. Only those past the second stage are searched for triggers."""
        setups = self.setups().filter("candidate")
        hits = self.triggers(setups.filter("stage2")).groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("hits"))
        rows = self.stage1.filter("candidate").select("symbol", "date", "place", "ac").join(setups.select("symbol", "date", F.col("price").alias("session_price"), "confluence", "stage2"), ["symbol", "date"], "left").join(hits, ["symbol", "date"], "left")
        return rows.selectExpr("symbol", "date", "place", "coalesce(session_price, ac) AS price", "coalesce(confluence, '') AS confluence", "coalesce(stage2, false) AS stage2", "coalesce(hits, 0) AS trigger_count").selectExpr("*", "stage2 AND trigger_count > 0 AS stage3", f"{I.READINESS} AS primary_label")


PLACE = ["CAST(row_number() OVER (PARTITION BY date ORDER BY floor(mansfield * 1e8 + 0.50001) DESC, floor(rv20 * 1e8 + 0.50001) DESC, symbol) AS INT) AS place", "count(*) OVER (PARTITION BY date) AS n"]

# ---- reference SQL ---------------------------------------------------------------------

_KEY = ", ".join(SESSION)
_SQL_SECONDS = _SECONDS
cte("x_sdays", f"SELECT DISTINCT CAST(ts AS DATE) - {EVENT_SHIFT_DAYS} AS day FROM events")
cte("x_sheld", "SELECT d.day AS session_day, b.* FROM (SELECT day, symbol AS sid FROM x_sdays CROSS JOIN (SELECT symbol FROM x_symbols WHERE asset_type = 'stock')) d ASOF JOIN x_mansfield b ON d.sid = b.symbol AND d.day >= b.date")
cte("x_sema", f"SELECT h.symbol, h.date, {I._ema_sql(10)} AS ema10, {I._ema_sql(20)} AS ema20 FROM (SELECT k.symbol, k.date, list(b.ac ORDER BY b.bar_idx) AS a FROM (SELECT DISTINCT symbol, date FROM x_sheld) k JOIN x_bars b ON b.symbol = k.symbol AND b.date <= k.date GROUP BY k.symbol, k.date) h")
cte("x_sstage1a", f"SELECT h.symbol, h.session_day AS date, h.date AS bar_date, h.ac, {', '.join('e.' + c if c.startswith('ema') else 'h.' + c for c in I.STAGE1)} FROM x_sheld h JOIN x_sema e ON e.symbol = h.symbol AND e.date = h.date")
cte("x_sstage1", f"SELECT *, {CALM.candidate()} AS candidate FROM (SELECT *, {', '.join(PLACE)} FROM x_sstage1a WHERE {I._NO_NULL})")
cte("x_sticks", f"SELECT h.symbol, h.session_day AS date, timeframe, event_id, CAST(floor((CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) % 86400) / ({_SQL_SECONDS})) AS INT) AS slot, {I.PRICE} AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, h.ac, h.atr20 FROM (SELECT *, unnest([{', '.join(repr(t) for t in TIMEFRAMES)}]) AS timeframe FROM events) e JOIN x_sheld h ON h.symbol = 'S' || lpad(CAST(user_id % (SELECT count(*) FROM supplier) AS VARCHAR), 6, '0') AND h.session_day = CAST(ts AS DATE) - {EVENT_SHIFT_DAYS}")
cte("x_sbars1", f"SELECT {_KEY}, slot, arg_min(price, event_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, event_id) AS close, CAST(sum(100 + 10 * k) AS DOUBLE) AS volume, any_value(ac) AS ac, any_value(atr20) AS atr20 FROM x_sticks GROUP BY {_KEY}, slot")
cte("x_sbars", f"SELECT *, CAST(row_number() OVER (PARTITION BY {_KEY} ORDER BY slot) - 1 AS INT) AS idx, CAST(count(*) OVER (PARTITION BY {_KEY}) AS INT) AS n FROM x_sbars1")
cte("x_sbins", f"SELECT {_KEY}, {I.BIN_SIZE} AS bin_size, {I.BIN} AS bin, sum(volume) AS vol, sum({I.HLC3} * volume) AS pv FROM x_sbars GROUP BY ALL")
cte("x_sbinned", f"SELECT {_KEY}, bin_size, sum(vol) AS total, sum(pv) / nullif(sum(vol), 0) AS vwap, list(bin ORDER BY bin) AS bins, list(vol ORDER BY bin) AS vols, max(vol) AS top FROM x_sbins GROUP BY {_KEY}, bin_size")
cte("x_spoc", "SELECT *, len(vols) + 1 - list_position(list_reverse(vols), top) AS peak FROM x_sbinned")
_AREA = f"""x_sarea AS (SELECT {_KEY}, total, vols, peak AS lo, peak AS hi, top AS c FROM x_spoc
 UNION ALL SELECT {_KEY}, total, vols, CASE WHEN up THEN lo ELSE lo - 1 END, CASE WHEN up THEN hi + 1 ELSE hi END, c + CASE WHEN up THEN vols[hi + 1] ELSE vols[lo - 1] END
 FROM (SELECT *, hi < len(vols) AND vols[hi + 1] >= CASE WHEN lo > 1 THEN vols[lo - 1] ELSE 0 END AS up FROM x_sarea WHERE c < {I.VALUE_AREA} * total AND (hi < len(vols) OR lo > 1))),
x_sprofile AS (SELECT {_KEY}, p.bin_size, p.total, p.vwap, p.bins[p.peak] * p.bin_size AS poc, p.bins[a.lo] * p.bin_size AS val, p.bins[a.hi] * p.bin_size AS vah FROM x_spoc p JOIN (SELECT {_KEY}, min(lo) AS lo, max(hi) AS hi FROM x_sarea GROUP BY {_KEY}) a USING ({_KEY})),
x_ssetups AS (SELECT *, {I.CONFLUENCE} AS confluence, {I.PASSES} AS stage2 FROM (SELECT p.*, s.ema10, s.ema20, s.place, s.candidate, b.close AS price FROM x_sprofile p JOIN x_sstage1 s USING (symbol, date) JOIN x_sbars b USING ({_KEY}) WHERE timeframe = '{PROFILE}' AND b.idx = b.n - 1)),
x_sseen AS (SELECT *, {I._named(I.more(_KEY))} FROM (SELECT *, {I._named(I.measured(_KEY, RANGES))} FROM (SELECT b.*, u.poc, u.val, u.vwap, u.ema10, u.ema20 FROM x_sbars b JOIN x_ssetups u USING (symbol, date) WHERE b.timeframe = '{TRIGGER}'))),
x_strig AS (SELECT {_KEY}, trigger_type, min(slot) AS slot, arg_min(close, idx) AS close, arg_min(level, idx) AS level, arg_min(spike, idx) AS spike, arg_min(hit, idx) AS hit FROM ({' UNION ALL '.join(f"SELECT {_KEY}, slot, idx, close, '{t}' AS trigger_type, {hit} AS hit, {level} AS level, {spike} AS spike FROM x_sseen WHERE {hit} OR {stop} = 1" for t, stop, hit, level, spike in I.rule_parts(RANGES))}) GROUP BY {_KEY}, trigger_type)"""
_READY = f"SELECT *, stage2 AND trigger_count > 0 AS stage3, {I.READINESS} AS primary_label FROM (SELECT c.symbol, c.date, c.place, coalesce(u.price, c.ac) AS price, coalesce(u.confluence, '') AS confluence, coalesce(u.stage2, false) AS stage2, CASE WHEN u.stage2 THEN coalesce(h.hits, 0) ELSE 0 END AS trigger_count FROM x_sstage1 c LEFT JOIN x_ssetups u ON u.symbol = c.symbol AND u.date = c.date LEFT JOIN (SELECT symbol, date, count(*) AS hits FROM x_strig WHERE hit GROUP BY symbol, date) h ON h.symbol = c.symbol AND h.date = c.date WHERE c.candidate)"


def recursive(final: str) -> str:
    """The statement with value areas, setups, triggers and readiness in front."""
    head, tail = with_(f"/*areas*/ {final} /* x_spoc x_sstage1 x_sbars */").split("/*areas*/")
    return head.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + _AREA + f",\nx_sready AS ({_READY})\n" + tail


_B = [*SESSION, "slot", "idx", "volume", *(r6(c) for c in ("open", "high", "low", "close"))]
_1 = ["symbol", "date", "bar_date", "place", "candidate", *(r6(c) for c in I.STAGE1)]
_P = [*SESSION, "total", *(r6(c) for c in ("bin_size", "vwap", "poc", "val", "vah"))]
_S = [*SESSION, "place", "candidate", r6("price"), "confluence", "stage2"]
_T = [*SESSION, "trigger_type", "slot", r6("close"), r6("level"), r6("spike")]
_R = ["symbol", "date", "place", r6("price"), "confluence", "stage2", "stage3", "trigger_count", "primary_label"]
QUERIES = {
    "s02_session_bars": lambda spark, d: Sessions(spark, d, CALM).bars.selectExpr(*_B),
    "q24_session_stage1": lambda spark, d: Sessions(spark, d, CALM).stage1.selectExpr(*_1),
    "a16_session_profiles": lambda spark, d: Sessions(spark, d, CALM).profiles().selectExpr(*_P),
    "q25_session_setups": lambda spark, d: Sessions(spark, d, CALM).setups().selectExpr(*_S),
    "q31_session_triggers": lambda spark, d: Sessions(spark, d, CALM).triggers().selectExpr(*_T),
    "q23_session_readiness": lambda spark, d: Sessions(spark, d, CALM).readiness().selectExpr(*_R),
}
ORACLE = {
    "s02_session_bars": with_(f"SELECT {', '.join(_B)} FROM x_sbars"),
    "q24_session_stage1": with_(f"SELECT {', '.join(_1)} FROM x_sstage1"),
    "a16_session_profiles": recursive(f"SELECT {', '.join(_P)} FROM x_sprofile"),
    "q25_session_setups": recursive(f"SELECT {', '.join(_S)} FROM x_ssetups"),
    "q31_session_triggers": recursive(f"SELECT {', '.join(_T)} FROM x_strig WHERE hit"),
    "q23_session_readiness": recursive(f"SELECT {', '.join(_R)} FROM x_sready"),
}
