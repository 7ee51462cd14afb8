"""Lists of what is missing, candidates' limits, timeframes, texts of figures, the screen's order."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewheel.functions.expressions import decimals, multiple, percent, range_bars, timeframe_minutes
from tidewheel.plans import quality, report, screener, sessions

DAY = dt.date(2031, 3, 3)


def test_missing_lists_name_each_gap(spark):
    bars = [("SPY", DAY + dt.timedelta(k)) for k in range(70)] + [("OLD", DAY + dt.timedelta(k)) for k in range(65)] + [("NEW", DAY + dt.timedelta(k)) for k in range(60, 70)]
    df = lambda rows, kind: spark.createDataFrame(rows, kind)
    got = quality.missing(
        df([("SPY",), ("OLD",), ("NEW",)], "symbol string"), df([("North", "FN"), ("South", "XX")], "sector string, sector_etf string"), df(bars, "symbol string, date date"), df([("RAIN", DAY)], "series string, date date"),
        df([("SPY",), ("OLD",), ("NEW",), ("NONE",)], "symbol string"), df([("North", "FN"), ("South", "FS")], "sector string, sector_etf string"), df([("RAIN",), ("SNOW",)], "series string"),
    )
    assert sorted(tuple(r) for r in got.collect()) == [("macro_series", "SNOW", "none"), ("price_bars", "NEW", "10 bars"), ("price_bars", "NONE", "none"), ("price_bars", "OLD", "up to 2031-05-06"), ("sector_map", "South/FS", ""), ("symbol", "NONE", "")]


def test_candidates_are_the_first_of_each_day(spark):
    rows = [(d, p, 10, 0.05 if p != 2 else 0.01, 2.0) for d in (1, 2) for p in range(1, 11)]
    df = spark.createDataFrame(rows, "date int, place int, n int, adr20 double, rv20 double")
    pick = lambda **k: {(r.date, r.place) for r in df.filter("true").selectExpr("*", f"{sessions.Limits(**k).candidate()} AS c").filter("c").collect()}
    assert pick() == {(1, 1), (2, 1)}  # a tenth of ten
    assert pick(share=0.5) == {(d, p) for d in (1, 2) for p in (1, 3, 4, 5)}
    assert pick(share=0.5, most=2) == {(d, p) for d in (1, 2) for p in (1, 3)}
    assert pick(rvol=2.0) == set()


@pytest.mark.parametrize(("timeframe", "minutes"), [("5Min", 5), ("30Min", 30), ("2Hour", 120)])
def test_timeframes(timeframe, minutes):
    assert timeframe_minutes(timeframe) == minutes and range_bars(30, timeframe) == max(1, -(-30 // minutes))


@pytest.mark.parametrize("timeframe", ["", "Min", "0Min", "xMin", "1Day", "-5Min", "5 Min"])
def test_odd_timeframes_are_refused(timeframe):
    with pytest.raises(ValueError, match="timeframe"):
        timeframe_minutes(timeframe)


def test_texts_of_figures(spark):
    values = [0.0, 1.25, -1.25, 99.999, 1234.5, -0.004, 0.05]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = [("0.0", "0.00%", "0.00x"), ("1.3", "125.00%", "1.25x"), ("-1.3", "-125.00%", "-1.25x"), ("100.0", "9999.90%", "100.00x"), ("1234.5", "123450.00%", "1234.50x"), ("-0.0", "-0.40%", "-0.00x"), ("0.1", "5.00%", "0.05x")]
    assert [tuple(r) for r in df.selectExpr(f"{decimals('v', 1)} AS a", f"{percent('v')} AS b", f"{multiple('v')} AS c").collect()] == want
    for v, w in zip(values, want, strict=True):
        assert duckdb.sql(f"SELECT {decimals('v', 1, 'VARCHAR')}, {percent('v', 'VARCHAR')}, {multiple('v', 'VARCHAR')} FROM (SELECT {v}::DOUBLE AS v)").fetchall() == [w]


def test_hydrated_rows_have_defaults(spark):
    watch = spark.createDataFrame([(DAY, 1, "A", 80.0, "why"), (DAY, 2, "B", 70.0, "why")], "score_date date, rank int, symbol string, score double, reason string")
    stocks = spark.createDataFrame([(DAY, "A", "recent_news:1", "Name", "Sea", "Boats", "pullback_leader", "pullback_leader", 0.1, None, 0.3, 0.4)], "score_date date, symbol string, catalyst string, name string, sector string, industry string, primary string, labels string, dist20 double, dist50 double, atr_ext20 double, dist20high double")
    a, b = sorted(report.hydrated(watch, stocks).collect(), key=lambda r: r.rank)
    assert (a.catalyst, a.name, a.dist20, a.dist50) == ("recent_news:1", "Name", 0.1, 0.0)
    assert (b.catalyst, b.name, b.primary, b.dist20, b.score) == ("pending_source", "", "", 0.0, 70.0)


def test_the_screen_keeps_the_first_row_and_the_last_figures(spark):
    good = ("Energy", 3e9, 3.0, 0.1, 10.0, 1.0, 1.0, 1.0, 20.0, 1.0)
    kind = "place int, ticker string, company string, sector string, market_cap double, dividend_yield double, debt_equity double, pe double, pb double, eps_growth double, roa double, roe double, net_margin double"
    rows = spark.createDataFrame([(3, "A", "late", *good), (1, "A", "first", *good), (2, "A", "second", *good), (1, "B", "b", *good[:4], 25.0, *good[5:])], kind)
    limits = screener.thresholds(spark).drop("no")
    extra = spark.createDataFrame([(1, "A", "old"), (5, "A", "new"), (2, "C", "x")], "place int, ticker string, brand string")
    assert [(r.ticker, r.company, r.brand) for r in screener.screen(rows, limits, extra).collect()] == [("A", "first", "new")]
    assert [r.brand for r in screener.screen(rows, limits, extra.filter(F.col("ticker") == "C")).collect()] == [""]
