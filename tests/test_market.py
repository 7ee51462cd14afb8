"""The market plans: oracles on the smallest tables, hand-computed fixtures, no look-ahead."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewheel import registry
from tidewheel.functions.expressions import r6
from tidewheel.operators import features, store
from tidewheel.plans import intraday
from tidewheel.plans.scores import Market
from tidewheel.sources import adapter, landed

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
DAY = dt.date(2031, 3, 3)


def plain(rows):
    return sorted(tuple("~" if v is None or v != v else str(v)[:10] if isinstance(v, dt.date) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("key", sorted(registry.oracle_sql()))
def test_oracle(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = registry.queries()[key](spark, SF)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[key]})").fetchall()
    assert plain(got.select(*columns).collect()) == plain(want)


def daily(spark, symbol, closes, volumes):
    rows = [(symbol, DAY + dt.timedelta(k), c, c * 1.02, c * 0.99, c, c, v) for k, (c, v) in enumerate(zip(closes, volumes, strict=True))]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, ac double, volume double")


def test_daily_measures(spark):
    """A line of 1, 2, ... 72 against a flat benchmark: its means can be had by hand."""
    n = 72
    line = daily(spark, "LINE", [float(k + 1) for k in range(n)], [400.0] * (n - 1) + [1000.0])
    both = features.bars(line.union(daily(spark, "SPY", [8.0] * n, [7.0] * n)))
    row = intraday.mansfield(both, intraday.benchmark(both)).filter("symbol = 'LINE' AND next_date IS NULL").join(intraday.ema_last(both), "symbol").first()
    assert row.adr20 == pytest.approx(0.03) and row.rv20 == pytest.approx(2.5)
    assert row.mansfield == pytest.approx(72 / 47.5)  # the mean of 23 to 72
    assert (row.ema10, row.ema20) == (pytest.approx(72 - 4.5), pytest.approx(72 - 9.5))  # seeded with the mean, a line stays (n - 1) / 2 behind
    assert (row.ma20, row.ma50, row.high20, row.low10) == (62.5, 47.5, 72.0, 63.0)
    assert row.r5 == pytest.approx(72 / 67 - 1) and row.trend_state == "above_20d_50d"


def test_no_look_ahead(spark):
    prices = adapter.prices_daily(spark, SF)
    dates = sorted(r[0] for r in prices.filter("symbol = 'SPY'").select("date").collect())
    cut = dates[100]
    whole, past = Market(spark, SF), Market(spark, SF, bars=features.bars(prices.filter(F.col("date") <= F.lit(cut))))
    pick = lambda m: sorted(m.stock_scores().filter(F.col("score_date") == F.lit(cut)).selectExpr("symbol", "rank", r6("score")).collect())
    assert pick(whole) == pick(past) and pick(whole)


def minutes(spark, bars, symbol="S"):
    rows = [(symbol, k, k, len(bars), float(c), float(h), float(lo), float(c), float(v), 100.0, 0.1) for k, (h, lo, c, v) in enumerate(bars)]
    return spark.createDataFrame(rows, "symbol string, slot long, idx int, n int, open double, high double, low double, close double, volume double, ac double, atr20 double")


LEVELS = "symbol string, poc double, val double, vwap double, ema10 double, ema20 double"


def test_value_area_takes_the_fuller_side_and_up_on_ties(spark):
    """From 52 (90) up to 53 (40, as much as 51), then down to 51 (40 against 10): 170 of 210."""
    bars = minutes(spark, [(p, p, p, v) for p, v in ((50, 30), (51, 40), (52, 90), (53, 40), (54, 10))])
    row = intraday.volume_profile(bars).first()
    assert (row.poc, row.val, row.vah, row.total) == (pytest.approx(52, abs=0.03), pytest.approx(51, abs=0.03), pytest.approx(53, abs=0.03), 210)
    assert row.vwap == pytest.approx((50 * 30 + 51 * 40 + 52 * 90 + 53 * 40 + 54 * 10) / 210)


FLAT = [(20.0, 19.8, 19.9, 400)] * 6
QUIET = [(30.05, 29.95, 30.0, 600)] * 3 + [(30.02, 29.98, 30.0, 300), (30.5, 30.0, 30.2, 1500)]


def test_triggers(spark):
    at = lambda x: spark.createDataFrame([("S", x, x, x, x, x)], LEVELS)
    kinds = lambda bars, x: {r.trigger_type for r in intraday.triggers(minutes(spark, bars), at(x)).collect()}
    assert kinds([*FLAT, (21.0, 20.0, 20.9, 900)], 3.0) == {"orb_breakout", "hod_break"}
    assert kinds([*FLAT, (21.0, 20.0, 20.9, 590)], 3.0) == set()  # 1.475 times the mean volume
    assert {"volume_dryup_confirmation", "micro_cluster_break"} <= kinds(QUIET, 30.0)
    assert kinds([(h, lo, c, 0) for h, lo, c, _ in FLAT] + [(21.0, 20.0, 20.9, 900)], 3.0) == set()  # a mean volume of zero ends the search


def test_readiness(spark):
    """Of four candidates one is ready, one is set up without a trigger, one has no confluence, one no session."""
    quiet = minutes(spark, QUIET, "READY").union(minutes(spark, [(30.0, 30.0, 30.0, 600)] * 5, "SETUP")).union(minutes(spark, QUIET, "FAR"))
    rows = [("READY", 30.3, 30.2), ("SETUP", 30.01, 30.0), ("FAR", 90.0, 80.0), ("NONE", 5.0, 4.0), ("OUT", 30.3, 30.2)]
    funnel = intraday.Funnel.__new__(intraday.Funnel)
    funnel.bars = quiet.withColumn("ac", F.lit(30.0))
    funnel.stage1 = spark.createDataFrame([(s, DAY, 31.0, a, b, k, s != "OUT") for k, (s, a, b) in enumerate(rows)], "symbol string, date date, ac double, ema10 double, ema20 double, place int, candidate boolean")
    got = {r.symbol: r for r in funnel.readiness().collect()}
    assert {k: r.primary_label for k, r in got.items()} == {"READY": "intraday_execution_ready", "SETUP": "structural_pullback_setup", "FAR": "high_momentum_universe", "NONE": "high_momentum_universe"}
    assert got["READY"].trigger_count > 0 == got["SETUP"].trigger_count and got["NONE"].price == 31.0 and got["NONE"].confluence == ""


def test_parsers(spark):
    requested = spark.createDataFrame([("ORCA",)], "symbol string")
    lines = spark.createDataFrame([("symbol,name,reportDate,fiscalDateEnding,estimate,currency",), (" orca ,Orca Boats,2031-05-02,2031-03-31,0.71,EUR",), ("TERN,y,2031-05-09,2031-03-31,4,EUR",), ("ORCA,y,soon,,,",)], "value string")
    assert [(r.symbol, str(r.date), r.estimate) for r in landed.earnings(lines, requested).collect()] == [("ORCA", "2031-05-02", 0.71)]
    filing = '{"filings": {"recent": {"form": ["10-K", "4", "8-K"], "filingDate": ["2031-02-10", "2031-02-11", "2031-02-11"], "accessionNumber": ["0000000042-31-000007", "x", "0000000042-31-000008"], "primaryDocument": ["k.htm", "x.htm", "e.htm"]}}}'
    found = landed.filings(spark.createDataFrame([("ORCA", 42, filing)], "symbol string, cik long, json string"), "2031-02-12").collect()
    assert [r.source_event_id for r in found] == ["submissions:0000000042:0000000042-31-000007", "submissions:0000000042:0000000042-31-000008"] and found[0].url.endswith("/42/000000004231000007/k.htm")
    macro = spark.createDataFrame([("RAIN", '{"observations": [{"date": "2031-02-01", "value": "."}, {"date": "2031-02-02", "value": "-3.5"}]}')], "series string, json string")
    assert [r.value for r in landed.observations(macro).collect()] == [-3.5]
    bars = spark.createDataFrame([('{"bars": {"ORCA": [{"t": "2031-02-03T05:00:00Z", "o": 7, "h": 9, "l": 6, "c": 8, "v": 3, "vw": 7.5}]}}',)], "json string")
    assert landed.bars(bars).first().ac == 8.0 and landed.intraday(bars, "2031-02-03").count() == 1 and landed.intraday(bars, "2031-02-04").count() == 0
    page = "<table><tr><th>Symbol</th></tr><tr><td> ORCA </td><td>Orca\n Boats</td><td>Information Technology</td><td>Hulls</td></tr></table><a href='?v=1&r=21'></a><a href='?v=1&r=61'></a>"
    pages = spark.createDataFrame([(1, page), (2, None)], "id long, html string")
    assert [tuple(r) for r in landed.members(pages, "id").collect()] == [("ORCA", "Orca Boats", "Technology", "Hulls")]
    assert [r[0] for r in pages.orderBy("id").select(landed.page_count("html")).collect()] == [4, 1]


@pytest.mark.parametrize("key", ["q10_actionability", "q14_watchlist_labels", "q20_backtest", "q21_event_context", "q22_actionability"])
def test_plans_read_stored_tables(spark, key):
    plan = registry.queries()[key](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and plan.count("Relation") < 20


def test_upsert_keeps_the_last_row_of_a_key(spark):
    old = spark.createDataFrame([("a", "1", "old"), ("b", "2", "stays")], "source string, source_event_id string, headline string")
    new = spark.createDataFrame([("a", "1", "z first", 1), ("a", "1", "a second", 2), ("c", "", "no id", 3)], "source string, source_event_id string, headline string, seq int")
    got = store.upsert(old, new, store.KEYS["events"], order="seq").collect()
    assert sorted((r.source, r.headline) for r in got) == [("a", "a second"), ("b", "stays")]


def test_store(spark, tmp_path):
    a = spark.createDataFrame([("x", DAY, 1.0), ("y", DAY, 2.0)], "symbol string, date date, close double")
    b = spark.createDataFrame([("x", DAY, 3.0)], "symbol string, date date, close double")
    once = store.upsert(a, b, store.KEYS["prices_daily"])
    assert sorted(r.close for r in once.collect()) == [2.0, 3.0] == sorted(r.close for r in store.upsert(once, b, store.KEYS["prices_daily"]).collect())
    path = str(tmp_path / "scores")
    store.replace_partitions(a.union(spark.createDataFrame([("z", DAY + dt.timedelta(1), 4.0)], a.schema)), path)
    store.replace_partitions(b, path)
    assert sorted(r.close for r in spark.read.parquet(path).collect()) == [3.0, 4.0]
    m = Market(spark, SF)
    assert store.snapshots(m.regime().select("score_date", "label"), m.sectors().select("score_date", "rank", "sector"), m.stock_scores().select("score_date", "rank", "symbol")).filter("json LIKE '%sectors%'").count() > 0
