"""Steps that many plans share shuffle and write no more than they must, with the same results."""

import datetime as dt
import glob
import math
import random
import re

import pytest

from tidewheel import registry
from tidewheel.operators import features, store
from tidewheel.plans import labels
from tidewheel.plans.intraday import sector_mansfield
from tidewheel.plans.scores import Market
from tidewheel.plans.sessions import Sessions, ema_at
from tidewheel.sources import adapter, provider

SF = "/root/testdata/sf0.001"
DAY = dt.date(2031, 3, 3)


def shared(spark):
    return glob.glob(store.shared_folder(spark).removeprefix("file://") + "/market/*")


def test_bars_of_stocks_are_made_in_place(spark):
    bars = features.stock_bars(spark, SF)
    assert "Exchange" not in bars._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in Market(spark, SF).eff.select("score_date", "symbol", "r20")._jdf.queryExecution().executedPlan().toString()


def test_scores_store_neither_bars_nor_bars_in_effect(spark, tmp_path):
    before = set(shared(spark))
    store._STORED.clear()
    Market(spark, SF).stock_scores()
    names = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(shared(spark)) - before}
    assert "stock_scores" in names and not names & {"bars", "effective"}


def test_equal_scores_are_stored_by_symbol(spark):
    """70 stocks of one score and 5 better ones: the better ones, then the first of the equal ones; their returns are the day's."""
    days = [DAY + dt.timedelta(k) for k in range(64)]
    up = [100.0 + k for k in range(64)]
    rows = [("SPY", d, 50.0, 50.0, 50.0, 50.0, 50.0, 1e6) for d in days]
    rows += [(f"S{n:03}", d, c, c, c, c, c, 1e6) for n in range(75) for d, c in zip(days, up if n >= 70 else [100.0] * 64, strict=True)]
    bars = features.bars(spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, ac double, volume double"))
    members = spark.createDataFrame([(f"S{n:03}", "x", "stock", "E", "O") for n in range(75)], "symbol string, name string, asset_type string, sector string, industry string")
    m = Market(spark, "", bars=bars, members=members, funds=spark.createDataFrame([("E", "XE")], "sector string, sector_etf string"))
    seen = m.stock_scores().select("score_date", "rank", "symbol", "bar_date", "fwd1").collect()
    assert {r.score_date for r in seen} == set(days[60:]) and len(seen) == 4 * 50
    for day in days[60:]:
        named = [r.symbol for r in sorted(seen) if r.score_date == day]
        assert named == [f"S{n:03}" for n in (*range(70, 75), *range(45))]
    ahead = {(r.score_date, r.symbol): r.fwd1 for r in seen if r.bar_date == r.score_date}
    assert ahead[days[60], "S070"] == 161 / 160 - 1 and ahead[days[63], "S070"] is None and ahead[days[60], "S000"] == 0.0


def test_catalysts_at_the_ends_of_their_days(spark):
    day = lambda k: DAY + dt.timedelta(k)
    stocks = spark.createDataFrame([(day(0), s) for s in "ABCDEF"], "score_date date, symbol string")
    events = [(1, "A", day(-7), "news", "n"), (2, "B", day(-8), "news", "n"), (3, "C", day(-14), "filing", "8-K filed"), (4, "D", day(30), "earnings", "e"), (5, "E", day(31), "earnings", "e"), (6, "F", day(1), "filing", "10-K filed"), (7, "A", day(-7), "news", "n")]
    status = labels.catalysts(stocks, spark.createDataFrame(events, "event_id long, symbol string, date date, event_type string, headline string"))
    assert {r.symbol: r.catalyst for r in status.collect()} == {"A": "recent_news:2", "B": "pending_source", "C": "filing:8-K", "D": f"earnings:{day(30)}", "E": "pending_source", "F": "pending_source"}



def test_catalysts_of_many_days_by_cells(spark):
    """Events of all days around the score dates against plain Python; a row is repeated six times at most and not gathered in the driver."""
    rng = random.Random(8)
    first = dt.date(1969, 12, 1)  # days before 1970 have negative numbers
    stocks = [(first + dt.timedelta(k), s) for k in range(0, 90) for s in ("A", "B", "C") if rng.random() < 0.7]
    events = [(n, rng.choice("ABCD"), first + dt.timedelta(rng.randrange(-40, 140)), t, f"{rng.choice(('8-K', '10-Q'))} filed") for n, t in enumerate(rng.choices(("news", "filing", "earnings"), k=60))]
    rows = spark.createDataFrame(stocks, "score_date date, symbol string")
    status = labels.catalysts(rows, spark.createDataFrame(events, "event_id long, symbol string, date date, event_type string, headline string"))
    got = {(r.score_date, r.symbol): r.catalyst for r in status.collect()}
    for day, s in stocks:
        near = lambda t, a, b, day=day, s=s: [(e[2], e[0], e[4]) for e in events if e[1] == s and e[3] == t and a <= (e[2] - day).days <= b]
        news, earnings, filings = near("news", -7, 0), near("earnings", 0, 30), near("filing", -14, 0)
        parts = [f"recent_news:{len(news)}"] * bool(news) + [f"earnings:{min(earnings)[0]}" for _ in earnings[:1]] + [f"filing:{max(filings)[2].split()[0]}" for _ in filings[:1]]
        assert got.pop((day, s)) == (" | ".join(parts) or "pending_source")
    assert not got
    assert labels.asked(rows).count() <= 6 * len(stocks)
    plan = status._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [symbol" in plan and "BroadcastHashJoin [symbol" not in plan


def test_a_feed_lands_alone(spark):
    root = provider.land(spark, SF, "earnings").removeprefix("file://")
    assert [p.rsplit("/", 1)[1] for p in glob.glob(f"{root}/*")] == ["earnings"]


def test_frames_are_made_of_pieces(spark):
    """No frame of a window over bars meets a bar more than ten times; 50 and 60 bars are made of such pieces."""
    plan = Market(spark, SF).stock_bars._jdf.queryExecution().optimizedPlan().toString()
    plan += sector_mansfield(Market(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    backs = [int(x) for x in re.findall(r"specifiedwindowframe\(RowFrame, -(\d+), currentrow\$\(\)\)", plan)]
    assert backs and max(backs) <= 9


def test_frames_of_pieces_have_the_values_of_whole_frames(spark):
    rng = random.Random(5)
    days = [DAY + dt.timedelta(k) for k in range(140)]
    rows = []
    for s in ("A", "B"):
        for k, d in enumerate(days):
            c = 0.0 if k % 37 == 5 else None if k % 41 == 7 else rng.uniform(50, 150)
            rows.append((s, d, c, None if c is None else c + 1, c, c, c, float(rng.randrange(1000))))
    prices = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, ac double, volume double")
    plain = prices
    for layer in (features.BASE, features.RANGES, features.MEANS):
        plain = plain.selectExpr("*", *(f"{x} AS {k}" for k, x in layer.items()))
    plain = plain.selectExpr("symbol", "date", *(f"{x} AS {k}" for k, x in features.FINAL.items())).selectExpr("*", f"{features.TREND} AS trend_state")
    made = features.bars(prices).select(*plain.columns).orderBy("symbol", "date").collect()
    for a, b in zip(made, plain.orderBy("symbol", "date").collect(), strict=True):
        for k, x in a.asDict().items():
            assert x == pytest.approx(b[k], rel=1e-12) if isinstance(x, float) else x == b[k], (k, a.date)


def test_ranks_are_bounded_by_some_stocks_and_taken_of_all(spark):
    days = "explode(sequence(DATE '2031-03-03', DATE '2031-05-05')) AS date"
    price = "100D + CASE WHEN symbol = 'SPY' THEN 0 ELSE (xxhash64(symbol, date) % 100) / 10 END"
    prices = spark.range(2001).selectExpr("CASE WHEN id = 2000 THEN 'SPY' ELSE concat('S', id) END AS symbol", days).selectExpr("symbol", "date", f"{price} AS c").selectExpr("symbol", "date", "c AS open", "c AS high", "c AS low", "c AS close", "c AS ac", "1e6D AS volume")
    members = spark.range(2000).selectExpr("concat('S', id) AS symbol", "'x' AS name", "'stock' AS asset_type", "'E' AS sector", "'O' AS industry")
    m = Market(spark, "", bars=features.bars(prices), members=members, funds=spark.createDataFrame([("E", "XE")], "sector string, sector_etf string"))
    floors = m._floors()
    assert "pmod(xxhash64(" in floors._jdf.queryExecution().optimizedPlan().toString()
    least = {r.score_date: r.least for r in floors.collect()}
    scored = m._scored().select("score_date", "symbol", "score", "step").collect()
    assert len(least) == 4 and sum(r.step >= least[r.score_date] for r in scored) < len(scored) * 0.8
    best = {(r.score_date, r["rank"]): r.symbol for r in m._ranks().select("score_date", "rank", "symbol").collect()}
    for day in least:
        order = sorted((-math.floor(r.score * 1e8 + 0.50001), r.symbol) for r in scored if r.score_date == day)
        assert [best[day, k + 1] for k in range(50)] == [s for _, s in order[:50]]


def test_session_averages_are_walked_from_any_bar(spark):
    first = {"A": 120, "B": 15, "C": 9, "D": 60}
    rows = [(s, DAY + dt.timedelta(k), DAY + dt.timedelta(k + 1) if k + 1 < n else None, k, 50.0 + (k * 7) % 11) for s, n in first.items() for k in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, date date, next_date date, bar_idx int, ac double")
    asked = spark.createDataFrame([(DAY + dt.timedelta(k),) for k in (5, 12, 30, 100)], "score_date date")
    seen = {(r.symbol, r.date): (r.ema10, r.ema20) for r in ema_at(bars, asked).collect()}
    for s, d, _, k, _ in rows:
        closes = [50.0 + (j * 7) % 11 for j in range(k + 1)]
        for n, value in zip((10, 20), seen.get((s, d), (None, None)), strict=True):
            mean = sum(closes[:n]) / n
            for x in closes[n:]:
                mean = x * 2 / (n + 1) + mean * (1 - 2 / (n + 1))
            assert value is None if k + 1 < n or (s, d) not in seen else value == pytest.approx(mean)
    days = {(DAY + dt.timedelta(k)) for k in range(5, 101)}
    assert set(seen) == {(s, d) for s, d, nxt, *_ in rows if d in days or (nxt is None and d < DAY + dt.timedelta(5))} | {("C", DAY + dt.timedelta(8)), ("B", DAY + dt.timedelta(14)), ("D", DAY + dt.timedelta(59))}


def test_recent_prices_give_the_measures_of_all(spark):
    rng = random.Random(5)
    rows = []
    for s, first, step in (("A", 0, 1), ("B", 0, 3), ("C", 190, 1), ("D", 205, 2), ("E", 0, 190)):
        for k in range(first, 230, step):
            c = [round(rng.uniform(20, 60), 2) for _ in range(4)]
            rows.append((s, DAY + dt.timedelta(k), c[0], max(c), min(c), c[3], c[3], float(rng.randrange(1, 9))))
    prices = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, ac double, volume double")
    since = DAY + dt.timedelta(200)
    recent = features.recent_prices(prices, spark.createDataFrame([(since,)], "since date"))
    assert recent.groupBy("symbol").count().filter(f"symbol = 'A' AND count = {features.LOOKBACK + 30}").count() == 1
    in_effect = f"coalesce(next_date, DATE '9999-01-01') > DATE '{since}'"
    got, want = (sorted(map(tuple, features.bars(p).filter(in_effect).collect()), key=lambda r: r[:2]) for p in (recent, prices))
    columns = features.bars(prices).columns
    assert [r[:2] for r in got] == [r[:2] for r in want] and features.bars(recent).columns == columns
    for g, w in zip(got, want, strict=True):
        assert dict(zip(columns, g, strict=True)) == pytest.approx(dict(zip(columns, w, strict=True)), nan_ok=True)


def test_sessions_meet_stored_lines_in_one_table(spark):
    """Bars and first-stage measures of sessions come of one table by symbol and day; neither reads the lines again."""
    s = Sessions(spark, SF)
    s.daily()
    for made in (s._bars(), s._stage1()):
        assert "lines_" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_only_ranked_stocks_get_windows_for_their_measures(spark):
    """The symbols are picked below the windows of the bars, not above them."""
    m = Market(spark, SF)
    plan = m.bars_of(m.stock_scores().select("symbol").distinct())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Window [") < plan.index("Join LeftSemi")


def test_lines_are_shuffled_once_and_without_names(spark):
    """Symbols and proxies are made after the shuffle, which storing by symbol does not repeat."""
    plan = adapter._stock_lines(spark, SF, 8).repartition(8, "symbol")._jdf.queryExecution().executedPlan().toString()
    dealt = plan[plan.index("REPARTITION_BY_NUM"):]
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange hashpartitioning") == 2
    assert "AS symbol" in plan and "AS symbol" not in dealt and "PX_" in plan and "PX_" not in dealt


def test_means_are_summed_in_the_order_of_the_bars(spark):
    """Means of up to 20 bars have the bits of whole frames, so a close that is exactly its mean is above it where it is there."""
    rng = random.Random(5)
    rows = []
    for s in ("A", "B", "C"):
        for k in range(300):
            c = [rng.randrange(501, 509) / 10 for _ in range(3)]
            rows.append((s, DAY + dt.timedelta(k), c[0], max(c), min(c), c[2], c[2], float(rng.randrange(1, 50) * 1000)))
    prices = spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, ac double, volume double")
    plain = prices
    for layer in (features.BASE, features.RANGES, features.MEANS):
        plain = plain.selectExpr("*", *(f"{x} AS {k}" for k, x in layer.items()))
    exact = {k: x for k, x in features.FINAL.items() if k not in ("ma50", "above50")}  # the mean of 50 bars is made of pieces
    plain = plain.selectExpr("symbol", "date", "ac", *(f"{x} AS {k}" for k, x in exact.items())).orderBy("symbol", "date").collect()
    made = features.bars(prices).select(*plain[0].__fields__).orderBy("symbol", "date").collect()
    ties = [r.above20 for r in plain if r.ma20 is not None and abs(r.ac - r.ma20) < 1e-9]
    assert {True, False} == set(ties)
    assert made == plain


def test_prices_lie_by_month_without_indicators(spark):
    """Readers of prices by month write all prices and none of the forty columns that bars have."""
    before = set(shared(spark))
    store._STORED.clear()
    registry.queries()["p03_prices_before_a_day"](spark, SF)
    written = [p for p in set(shared(spark)) - before if p.rsplit("/", 1)[1].rsplit("-", 1)[0].endswith("-by-month")]
    prices = adapter.prices_daily(spark, SF)
    held = [spark.read.parquet(p) for p in written]
    assert [set(df.columns) for df in held] == [{*prices.columns, "month"}]
    assert held[0].count() == prices.count()
