"""Intraday funnel: momentum candidates, volume profiles with value areas, confluence, breakout triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.functions.expressions import r6, ratio
from tidewheel.operators.asof import effective
from tidewheel.operators.features import earlier, ends, mean, pieces, sums
from tidewheel.operators.oracle import cte, with_
from tidewheel.plans.scores import Market
from tidewheel.sources.adapter import read, stock_symbol

MIN_ADR, MIN_RVOL, TOP_SHARE = 0.04, 1.5, 0.10
VALUE_AREA, WINDOW, MIN_CONFLUENCE, EMA_FLOOR = 0.70, 0.0075, 3, -0.01
SPIKE, DRYUP, CLUSTER_RANGE = 1.5, 0.65, 0.01
BAR_MINUTES, RANGE_MINUTES = 30, 180
TYPES = ("orb_breakout", "hod_break", "volume_dryup_confirmation", "micro_cluster_break")

# ---- daily measures -------------------------------------------------------------


def mansfield(bars: DataFrame, benchmark: DataFrame, name: str = "mansfield", by: tuple[str, ...] = ("date",)) -> DataFrame:
    """bars with the ratio to the benchmark's close as of each day over its mean of 50 bars; null unless all are there.

    benchmark has bench and the columns `by`: the date, and what else it is picked by.
    """
    out = bars.join(F.broadcast(benchmark), list(by), "left").withColumn("ratio", F.expr(ratio("ac", "bench")))
    named = lambda d: [f"{x} AS {k}" for k, x in d.items()]
    at = ends(50, piece=10)
    out = out.selectExpr("*", *named(sums("ratio", "ratio", 10))).selectExpr("*", *named(earlier(["ratio_sum", "ratio_n"], at)))
    counted = " + ".join(pieces("ratio_n", at))  # null until there are 50 bars
    return out.withColumn("made_", F.expr(f"CASE WHEN {counted} = 50 THEN {ratio('ratio', mean('ratio', at))} END")).select(*bars.columns, *(c for c in benchmark.columns if c not in (*by, "bench")), F.col("made_").alias(name))


def benchmark(bars: DataFrame, symbol: str = "SPY") -> DataFrame:
    """(date, bench): the symbol's close in effect on every day on which anything traded."""
    dates = bars.select(F.col("date").alias("score_date")).distinct()
    return effective(bars.filter(F.col("symbol") == symbol), dates).select(F.col("score_date").alias("date"), F.col("ac").alias("bench"))


def sector_mansfield(market: Market) -> DataFrame:
    """Stocks' bars with the ratio to their sector's fund."""
    dates = market.etfs.select(F.col("date").alias("score_date")).distinct()  # the benchmark trades whenever a stock does
    held = effective(market.etfs.join(F.broadcast(market.funds.select(F.col("sector_etf").alias("symbol"))), "symbol", "left_semi"), dates)  # a row for each sector
    bench = held.select(F.col("score_date").alias("date"), F.col("symbol").alias("sector_etf"), F.col("ac").alias("bench")).join(F.broadcast(market.funds), "sector_etf").drop("sector_etf")
    return mansfield(market.stock_bars.join(market.stocks.select("symbol", "sector"), "symbol"), bench, "mansfield_sector", ("date", "sector"))


def _ema(n: int) -> str:
    seed = f"aggregate(slice(a, 1, {n}), 0D, (s, x) -> s + x) / {n}"
    return f"CASE WHEN size(a) >= {n} THEN aggregate(slice(a, {n + 1}, size(a)), {seed}, (s, x) -> x * {2 / (n + 1)!r}D + s * {1 - 2 / (n + 1)!r}D) END"


def ema_last(bars: DataFrame) -> DataFrame:
    """(symbol, ema10, ema20) at the last bar: seeded by the mean of the first n bars, then recursive.

    A symbol's closes are one array: as many numbers as it has trading days.
    """
    closes = bars.groupBy("symbol").agg(F.expr("transform(array_sort(collect_list(struct(bar_idx, ac))), e -> e.ac)").alias("a"))
    return closes.selectExpr("symbol", f"{_ema(10)} AS ema10", f"{_ema(20)} AS ema20")


def _ema_sql(n: int) -> str:
    return f"CASE WHEN len(a) >= {n} THEN list_reduce(list_prepend(list_reduce(a[1:{n}], lambda s, x: s + x) / {n}, a[{n + 1}:]), lambda s, x: x * {2 / (n + 1)!r}::DOUBLE + s * {1 - 2 / (n + 1)!r}::DOUBLE) END"


cte("x_ema", f"SELECT symbol, {_ema_sql(10)} AS ema10, {_ema_sql(20)} AS ema20 FROM (SELECT symbol, list(ac ORDER BY bar_idx) AS a FROM x_bars GROUP BY symbol)")
cte("x_ratio", "SELECT b.*, b.ac / nullif(p.ac, 0) AS ratio FROM x_bars b ASOF LEFT JOIN (SELECT date, ac FROM x_bars WHERE symbol = 'SPY') p ON b.date >= p.date")
cte("x_mansfield", "SELECT *, CASE WHEN count(ratio) OVER w = 50 THEN ratio / nullif(avg(ratio) OVER w, 0) END AS mansfield FROM x_ratio WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
cte("x_sector_ratio", "SELECT b.*, b.ac / nullif(p.ac, 0) AS ratio FROM (SELECT b.*, m.sector_etf FROM x_bars b JOIN x_symbols s ON s.symbol = b.symbol AND s.asset_type = 'stock' JOIN x_sector_map m ON m.sector = s.sector) b ASOF LEFT JOIN (SELECT symbol AS fund, date, ac FROM x_bars) p ON b.sector_etf = p.fund AND b.date >= p.date")
cte("x_mansfield_sector", "SELECT *, CASE WHEN count(ratio) OVER w = 50 THEN ratio / nullif(avg(ratio) OVER w, 0) END AS mansfield_sector FROM x_sector_ratio WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
STAGE1 = ["adr20", "rv20", "atr20", "mansfield", "ema10", "ema20"]
_NO_NULL = " AND ".join(f"{c} IS NOT NULL" for c in STAGE1)
_PLACE = "CAST(row_number() OVER (ORDER BY floor(mansfield * 1e8 + 0.50001) DESC, floor(rv20 * 1e8 + 0.50001) DESC, symbol) AS INT) AS place, count(*) OVER () AS n"
_CANDIDATE = f"adr20 > {MIN_ADR} AND rv20 > {MIN_RVOL} AND place <= greatest(1, ceil({TOP_SHARE} * n))"
_LAST = "next_date IS NULL"
cte("x_stage1a", f"SELECT m.symbol, m.date, m.close, m.ac, {', '.join(STAGE1)} FROM x_mansfield m JOIN x_ema e ON e.symbol = m.symbol JOIN x_symbols s ON s.symbol = m.symbol AND s.asset_type = 'stock' WHERE {_LAST}")
cte("x_stage1b", f"SELECT *, {_PLACE} FROM x_stage1a WHERE {_NO_NULL}")
cte("x_stage1", f"SELECT *, {_CANDIDATE} AS candidate FROM x_stage1b")


def stage1(market: Market) -> DataFrame:
    """Every stock's last bar with all measures, its place and whether it is a candidate; rows lacking one are dropped."""
    rows = mansfield(market.stock_bars, benchmark(market.etfs)).filter(_LAST).join(market.stocks.select("symbol"), "symbol").join(ema_last(market.stock_bars), "symbol")
    return rows.select("symbol", "date", "close", "ac", *STAGE1).filter(_NO_NULL).selectExpr("*", *_PLACE.replace(", count", "|count").split("|")).selectExpr("*", f"{_CANDIDATE} AS candidate")


# ---- intraday bars --------------------------------------------------------------

PRICE = "ac * (1 + (value - 50) / 10000)"


def prices_intraday(spark: SparkSession, sf_dir: str, market: Market) -> DataFrame:
    """Half-hour bars of stocks from the events: (symbol, slot, idx, n, open, high, low, close, volume, ac, atr20)."""
    suppliers = read(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("ns"))
    last = market.stock_bars.filter(_LAST).select("symbol", "ac", "atr20")
    ticks = read(spark, sf_dir, "events").crossJoin(F.broadcast(suppliers)).selectExpr(f"{stock_symbol('user_id % ns')} AS symbol", "event_id", f"CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000 / {BAR_MINUTES * 60}) AS BIGINT) AS slot", "value", "CAST(get_json_object(props, '$.k') AS BIGINT) AS k")  # one row
    priced = ticks.join(last, "symbol").withColumn("price", F.expr(PRICE))
    bars = priced.groupBy("symbol", "slot").agg(F.min_by("price", "event_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "event_id").alias("close"), F.expr("CAST(sum(100 + 10 * k) AS DOUBLE)").alias("volume"), F.first("ac").alias("ac"), F.first("atr20").alias("atr20"))
    by = "OVER (PARTITION BY symbol ORDER BY slot)"
    return bars.selectExpr("*", f"CAST(row_number() {by} - 1 AS INT) AS idx", "CAST(count(*) OVER (PARTITION BY symbol) AS INT) AS n")


cte("x_last", f"SELECT symbol, ac, atr20 FROM x_bars WHERE {_LAST}")
cte("x_ticks", f"SELECT l.symbol, event_id, CAST(floor(epoch_us(ts) / 1000000 / {BAR_MINUTES * 60}) AS BIGINT) AS slot, {PRICE} AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, l.ac, l.atr20 FROM events e JOIN x_last l ON l.symbol = 'S' || lpad(CAST(user_id % (SELECT count(*) FROM supplier) AS VARCHAR), 6, '0')")
cte("x_ibars1", "SELECT symbol, slot, arg_min(price, event_id) AS open, max(price) AS high, min(price) AS low, arg_max(price, event_id) AS close, CAST(sum(100 + 10 * k) AS DOUBLE) AS volume, any_value(ac) AS ac, any_value(atr20) AS atr20 FROM x_ticks GROUP BY symbol, slot")
cte("x_ibars", "SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY slot) - 1 AS INT) AS idx, CAST(count(*) OVER (PARTITION BY symbol) AS INT) AS n FROM x_ibars1")

# ---- volume profile -------------------------------------------------------------

HLC3 = "((high + low + close) / 3)"
BIN_SIZE = "least(greatest(ac * 0.0005, coalesce(atr20, 0.0) * 0.05, 0.01), greatest(0.01, ac * 0.002))"
BIN = f"CAST(round({HLC3} / {BIN_SIZE}) AS BIGINT)"
_STEP = "CASE WHEN s.c >= {v} * total THEN s WHEN s.hi < size(bins) AND bins[s.hi].vol >= CASE WHEN s.lo > 1 THEN bins[s.lo - 2].vol ELSE 0D END THEN struct(s.lo AS lo, s.hi + 1 AS hi, s.c + bins[s.hi].vol AS c) WHEN s.lo > 1 THEN struct(s.lo - 1 AS lo, s.hi AS hi, s.c + bins[s.lo - 2].vol AS c) ELSE s END".format(v=VALUE_AREA)


def volume_profile(bars: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(by, bin_size, total, vwap, poc, val, vah) of every session, told apart by the columns `by`.

    Volume meets in bins first; a session's occupied bins, bounded by its price range
    over the bin size, are one array on which the value area grows from the fullest
    bin (ties: the higher price) to the fuller side (ties: up).
    """
    binned = bars.selectExpr(*by, f"{BIN_SIZE} AS bin_size", f"{BIN} AS bin", "volume", f"{HLC3} AS p").groupBy(*by, "bin_size", "bin").agg(F.sum("volume").alias("vol"), F.expr("sum(p * volume)").alias("pv"))
    arrays = binned.groupBy(*by, "bin_size").agg(F.sum("vol").alias("total"), F.expr("sum(pv)").alias("pv"), F.array_sort(F.collect_list(F.struct("bin", "vol"))).alias("bins"), F.expr("max(struct(vol, bin))").alias("top"))
    area = f"aggregate(sequence(1, size(bins)), struct(peak AS lo, peak AS hi, top.vol AS c), (s, i) -> {_STEP})"
    grown = arrays.withColumn("peak", F.expr("CAST(array_position(transform(bins, b -> b.bin), top.bin) AS INT)")).withColumn("area", F.expr(area))
    return grown.selectExpr(*by, "bin_size", "total", "pv / nullif(total, 0) AS vwap", "top.bin * bin_size AS poc", "bins[area.lo - 1].bin * bin_size AS val", "bins[area.hi - 1].bin * bin_size AS vah")


cte("x_bins", f"SELECT symbol, {BIN_SIZE} AS bin_size, {BIN} AS bin, sum(volume) AS vol, sum({HLC3} * volume) AS pv FROM x_ibars GROUP BY 1, 2, 3")
cte("x_binned", "SELECT symbol, bin_size, sum(vol) AS total, sum(pv) / nullif(sum(vol), 0) AS vwap, list(bin ORDER BY bin) AS bins, list(vol ORDER BY bin) AS vols, max(vol) AS top FROM x_bins GROUP BY symbol, bin_size")
cte("x_poc", "SELECT *, len(vols) + 1 - list_position(list_reverse(vols), top) AS peak FROM x_binned")
_AREA = f"""RECURSIVE x_area AS (SELECT symbol, total, vols, peak AS lo, peak AS hi, top AS c FROM x_poc
 UNION ALL SELECT symbol, total, vols, CASE WHEN up THEN lo ELSE lo - 1 END, CASE WHEN up THEN hi + 1 ELSE hi END, c + CASE WHEN up THEN vols[hi + 1] ELSE vols[lo - 1] END
 FROM (SELECT *, hi < len(vols) AND vols[hi + 1] >= CASE WHEN lo > 1 THEN vols[lo - 1] ELSE 0 END AS up FROM x_area WHERE c < {VALUE_AREA} * total AND (hi < len(vols) OR lo > 1)))"""
_PROFILE_SQL = "SELECT p.symbol, p.bin_size, p.total, p.vwap, p.bins[p.peak] * p.bin_size AS poc, p.bins[a.lo] * p.bin_size AS val, p.bins[a.hi] * p.bin_size AS vah FROM x_poc p JOIN (SELECT symbol, min(lo) AS lo, max(hi) AS hi FROM x_area GROUP BY symbol) a USING (symbol)"


def recursive(final: str) -> str:
    """The statement with the value areas in front."""
    sql = with_(f"{_MARK} {final} /* x_poc */")
    head, tail = sql.split(_MARK)
    return head.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ",\n" + _AREA.replace("RECURSIVE ", "", 1) + f",\nx_profile AS ({_PROFILE_SQL})\n" + tail


_MARK = "/*areas*/"

# ---- confluence and triggers ----------------------------------------------------

LEVELS = ("poc", "val", "vwap", "ema10", "ema20")
_CLOSE = lambda level: f"(abs({level} / nullif(price, 0) - 1) <= {WINDOW})"
CONFLUENCE = "concat_ws('|', " + ", ".join(f"CASE WHEN {_CLOSE(x)} THEN '{x}' END" for x in LEVELS) + ")"
N_CONFLUENCE = "(" + " + ".join(f"CASE WHEN {_CLOSE(x)} THEN 1 ELSE 0 END" for x in LEVELS) + ")"
PASSES = f"coalesce(ema10 > ema20 AND {N_CONFLUENCE} >= {MIN_CONFLUENCE} AND price / nullif(ema20, 0) - 1 >= {EMA_FLOOR}, false)"
_near = lambda p: "(" + " OR ".join(f"coalesce(abs({p} / nullif({x}, 0) - 1) <= {WINDOW}, false)" for x in LEVELS) + ")"
K = -(-RANGE_MINUTES // BAR_MINUTES)


def measured(by: str = "symbol", ranges: dict[str, int] | None = None) -> dict[str, str]:
    """What triggers compare at each bar of a session; ranges has the opening range's bars of each timeframe, K bars without it."""
    rows = f"OVER (PARTITION BY {by} ORDER BY slot ROWS BETWEEN {{0}})"
    before = lambda k: rows.format(f"{k} PRECEDING AND 1 PRECEDING")
    back = lambda c: f"lag({c}, 1) OVER (PARTITION BY {by} ORDER BY slot)"
    prior = rows.format("UNBOUNDED PRECEDING AND 1 PRECEDING")
    mean = lambda k: f"CASE WHEN n > {k} THEN avg(volume) {before(k)} ELSE avg(volume) {prior} END"
    of_frame = "CASE timeframe " + " ".join(f"WHEN '{t}' THEN {mean(k)}" for t, k in (ranges or {}).items()) + " END"
    return {
        "avg_k": of_frame if ranges else mean(K),
        "avg_3": f"avg(volume) {before(3)}",
        "range_high": f"max(CASE WHEN idx < least({range_bars(ranges)}, n - 1) THEN high END) OVER (PARTITION BY {by})",
        "prior_high": f"max(high) {prior}",
        "c_high": f"max(high) {before(3)}",
        "c_low": f"min(low) {before(3)}",
        "p_high": back("high"),
        "p_close": back("close"),
        "p_volume": back("volume"),
    }


def more(by: str = "symbol") -> dict[str, str]:
    return {"p_avg_3": f"lag(avg_3, 1) OVER (PARTITION BY {by} ORDER BY slot)", "mid": "(c_high + c_low) / 2"}


def range_bars(ranges: dict[str, int] | None = None) -> str:
    return "CASE timeframe " + " ".join(f"WHEN '{t}' THEN {k}" for t, k in ranges.items()) + " END" if ranges else str(K)


_DRY = f"idx >= 4 AND n >= 5 AND {_near('p_close')} AND p_volume <= p_avg_3 * {DRYUP}"
_TIGHT = f"idx >= 3 AND mid <> 0 AND (c_high - c_low) / nullif(mid, 0) <= {CLUSTER_RANGE} AND {_near('mid')}"


def rule_parts(ranges: dict[str, int] | None = None) -> list[tuple[str, str, str, str, str]]:
    """(type, where a zero mean volume ends its search, where it fires, level, spike) of each trigger."""
    post = f"idx >= least({range_bars(ranges)}, n - 1) AND n > 1"
    #: For each trigger: where its volume test runs, the mean, the level, the price test.
    rules = {
        "orb_breakout": (post, "avg_k", "range_high", "high > range_high AND close > range_high"),
        "hod_break": ("idx >= 3", "avg_3", "prior_high", "high > prior_high AND close > prior_high"),
        "volume_dryup_confirmation": (_DRY, "avg_3", "p_close", "close > p_high"),
        "micro_cluster_break": (_TIGHT, "avg_3", "c_high", "close > c_high"),
    }
    return [(t, f"CASE WHEN coalesce({where}, false) AND {mean} = 0 THEN 1 ELSE 0 END", f"coalesce({where} AND {test} AND volume / nullif({mean}, 0) > {SPIKE}, false)", level, f"volume / nullif({mean}, 0)") for t, (where, mean, level, test) in rules.items()]


MEASURED, MORE, RULE_PARTS = measured(), more(), rule_parts()


def triggers(bars: DataFrame, levels: DataFrame, by: tuple[str, ...] = ("symbol",), on: tuple[str, ...] = ("symbol",), ranges: dict[str, int] | None = None) -> DataFrame:
    """(by, trigger_type, slot, close, level, spike): the first of each type in a session, unless a zero mean volume comes before.

    Sessions are told apart by the columns `by`; levels are joined on those of `on`.
    """
    seen = bars.drop("ac", "atr20").join(levels, list(on))
    key = ", ".join(by)
    named = lambda d: [f"{x} AS {k}" for k, x in d.items()]
    seen = seen.selectExpr("*", *named(measured(key, ranges))).selectExpr("*", *named(more(key)))
    parts = ", ".join(f"named_struct('trigger_type', '{t}', 'stop', {stop}, 'hit', {hit}, 'level', {level}, 'spike', {spike})" for t, stop, hit, level, spike in rule_parts(ranges))
    long = seen.selectExpr(*by, "slot", "idx", "close", f"inline(array({parts}))").filter("hit OR stop = 1")
    first = long.groupBy(*by, "trigger_type").agg(F.min_by(F.struct("slot", "close", "level", "spike", "hit"), "idx").alias("f"))
    return first.filter("f.hit").select(*by, "trigger_type", "f.slot", "f.close", "f.level", "f.spike")


_named = lambda d: ", ".join(f"{x} AS {k}" for k, x in d.items())
_LEVELLED = "(SELECT s.symbol, p.poc, p.val, p.vah, p.vwap, s.ema10, s.ema20, s.place, s.candidate FROM x_stage1 s JOIN x_profile p USING (symbol))"
_SETUP = f"(SELECT l.*, i.close AS price FROM {_LEVELLED} l JOIN x_ibars i ON i.symbol = l.symbol AND i.idx = i.n - 1)"
_TRIGGERS = "(SELECT symbol, trigger_type, min(slot) AS slot, arg_min(close, idx) AS close, arg_min(level, idx) AS level, arg_min(spike, idx) AS spike, arg_min(hit, idx) AS hit FROM (" + " UNION ALL ".join(f"SELECT symbol, slot, idx, close, '{t}' AS trigger_type, {hit} AS hit, {level} AS level, {spike} AS spike FROM seen WHERE {hit} OR {stop} = 1" for t, stop, hit, level, spike in RULE_PARTS) + ") GROUP BY symbol, trigger_type)"
_SEEN = f"seen AS (SELECT *, {_named(MORE)} FROM (SELECT *, {_named(MEASURED)} FROM (SELECT i.symbol, i.slot, i.idx, i.n, i.high, i.low, i.close, i.volume, l.poc, l.val, l.vwap, l.ema10, l.ema20 FROM x_ibars i JOIN {_LEVELLED} l USING (symbol))))"


#: How far a candidate came.
READINESS = "CASE WHEN stage2 AND trigger_count > 0 THEN 'intraday_execution_ready' WHEN stage2 THEN 'structural_pullback_setup' ELSE 'high_momentum_universe' END"
_READY_SQL = f"""(SELECT *, stage2 AND trigger_count > 0 AS stage3, {READINESS} AS primary_label FROM (
  SELECT c.symbol, c.date, c.place, coalesce(s.price, c.ac) AS price, coalesce(s.confluence, '') AS confluence, coalesce(s.stage2, false) AS stage2, CASE WHEN s.stage2 THEN coalesce(h.n, 0) ELSE 0 END AS trigger_count
  FROM x_stage1 c LEFT JOIN (SELECT symbol, price, {CONFLUENCE} AS confluence, {PASSES} AS stage2 FROM {_SETUP}) s ON s.symbol = c.symbol
  LEFT JOIN (SELECT symbol, count(*) AS n FROM {_TRIGGERS} WHERE hit GROUP BY symbol) h ON h.symbol = c.symbol WHERE c.candidate))"""


class Funnel:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.market = Market(spark, sf_dir)
        self.bars = self.market.table("prices_intraday", lambda: prices_intraday(spark, sf_dir, self.market))
        self.stage1 = self.market.table("stage1", lambda: stage1(self.market))

    def levels(self) -> DataFrame:
        return self.stage1.select("symbol", "ema10", "ema20", "place", "candidate").join(volume_profile(self.bars), "symbol").select("symbol", "poc", "val", "vah", "vwap", "ema10", "ema20", "place", "candidate")

    def setups(self) -> DataFrame:
        """Stocks with a profile: their latest price, confluence and whether they pass the second stage."""
        last = self.bars.filter("idx = n - 1").select("symbol", F.col("close").alias("price"))
        return self.levels().join(last, "symbol").selectExpr("*", f"{CONFLUENCE} AS confluence", f"{PASSES} AS stage2")

    def triggers(self) -> DataFrame:
        return triggers(self.bars, self.levels().drop("vah", "place", "candidate"))

    def readiness(self) -> DataFrame:
        """One row a candidate: how far it came, and why. Only those that pass the second stage are searched for triggers.

        A candidate without a session has its daily price and no confluence.
        """
        setups = self.setups().filter("candidate").select("symbol", F.col("price").alias("session_price"), "confluence", "stage2", "poc", "val", "vwap", "ema10", "ema20")
        levels = setups.filter("stage2").select("symbol", "poc", "val", "vwap", "ema10", "ema20")
        hits = triggers(self.bars.join(levels.select("symbol"), "symbol", "left_semi"), levels).groupBy("symbol").agg(F.count(F.lit(1)).alias("hits"))
        rows = self.stage1.filter("candidate").select("symbol", "date", "place", "ac").join(setups.select("symbol", "session_price", "confluence", "stage2"), "symbol", "left").join(hits, "symbol", "left")
        return rows.selectExpr("symbol", "date", "place", "coalesce(session_price, ac) AS price", "coalesce(confluence, '') AS confluence", "coalesce(stage2, false) AS stage2", "coalesce(hits, 0) AS trigger_count").selectExpr("*", "stage2 AND trigger_count > 0 AS stage3", f"{READINESS} AS primary_label")


_T = ["symbol", "trigger_type", "slot", r6("close"), r6("level"), r6("spike")]
_S = ["symbol", "place", "candidate", r6("price"), "confluence", "stage2"]
_P = ["symbol", "total", *(r6(c) for c in ("bin_size", "vwap", "poc", "val", "vah"))]
_B = ["symbol", "slot", "idx", "volume", *(r6(c) for c in ("open", "high", "low", "close"))]
_M = ["symbol", "date", r6("coalesce(mansfield, -9.0)", "mansfield")]
_E = ["symbol", r6("coalesce(ema10, -9.0)", "ema10"), r6("coalesce(ema20, -9.0)", "ema20")]
_R = ["symbol", "date", "place", r6("price"), "confluence", "stage2", "stage3", "trigger_count", "primary_label"]
_STAGES = ["count(*) AS stage1", "count(CASE WHEN stage2 THEN 1 END) AS stage2", "count(CASE WHEN stage3 THEN 1 END) AS stage3", "CAST(coalesce(sum(trigger_count), 0) AS BIGINT) AS triggers"]
_1 = ["symbol", "date", "place", "candidate", *(r6(c) for c in STAGE1)]
QUERIES = {
    "w14_ema": lambda spark, d: (lambda m: ema_last(m.stock_bars).unionByName(ema_last(m.etfs)).selectExpr(*_E))(Market(spark, d)),
    "w16_mansfield": lambda spark, d: (lambda m: mansfield(m.stock_bars, benchmark(m.etfs)).unionByName(mansfield(m.etfs, benchmark(m.etfs))).selectExpr(*_M))(Market(spark, d)),
    "q24_stage1": lambda spark, d: stage1(Market(spark, d)).selectExpr(*_1),
    "s02_prices_intraday": lambda spark, d: prices_intraday(spark, d, Market(spark, d)).selectExpr(*_B),
    "a16_volume_profile": lambda spark, d: volume_profile(prices_intraday(spark, d, Market(spark, d))).selectExpr(*_P),
    "q25_setups": lambda spark, d: Funnel(spark, d).setups().selectExpr(*_S),
    "q31_triggers": lambda spark, d: Funnel(spark, d).triggers().selectExpr(*_T),
    "w16_mansfield_sector": lambda spark, d: sector_mansfield(Market(spark, d)).selectExpr("symbol", "date", r6("coalesce(mansfield_sector, -9.0)", "mansfield_sector")),
    "q23_readiness": lambda spark, d: Funnel(spark, d).readiness().selectExpr(*_R),
    "q23_stage_counts": lambda spark, d: (lambda f: f.readiness().agg(*(F.expr(x) for x in _STAGES)).crossJoin(F.broadcast(f.stage1.agg(F.count(F.lit(1)).alias("evaluated")))))(Funnel(spark, d)),  # one row each
}
ORACLE = {
    "w14_ema": with_(f"SELECT {', '.join(_E)} FROM x_ema"),
    "w16_mansfield": with_(f"SELECT {', '.join(_M)} FROM x_mansfield"),
    "q24_stage1": with_(f"SELECT {', '.join(_1)} FROM x_stage1"),
    "s02_prices_intraday": with_(f"SELECT {', '.join(_B)} FROM x_ibars"),
    "a16_volume_profile": recursive(f"SELECT {', '.join(_P)} FROM x_profile"),
    "q25_setups": recursive(f"SELECT {', '.join(_S[:4])}, {CONFLUENCE} AS confluence, {PASSES} AS stage2 FROM {_SETUP}"),
    "w16_mansfield_sector": with_(f"SELECT symbol, date, {r6('coalesce(mansfield_sector, -9.0)', 'mansfield_sector')} FROM x_mansfield_sector"),
    "q23_readiness": recursive(f", {_SEEN} SELECT {', '.join(_R)} FROM {_READY_SQL}"),
    "q23_stage_counts": recursive(f", {_SEEN} SELECT {', '.join(_STAGES)}, (SELECT count(*) FROM x_stage1) AS evaluated FROM {_READY_SQL}"),
    "q31_triggers": recursive(f", {_SEEN} SELECT {', '.join(_T)} FROM {_TRIGGERS} WHERE hit"),
}
