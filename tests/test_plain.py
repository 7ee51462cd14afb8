"""Scores, labels and backtests of a small made market against plain Python that shares no expression with the plans."""

import datetime as dt
import math
import random
import statistics
from collections import defaultdict

import pytest

from tidewheel import config as C
from tidewheel.operators import features
from tidewheel.plans import backtest
from tidewheel.plans.labels import catalysts, macro_asof, macro_flags
from tidewheel.plans.scores import Market

START = dt.date(2031, 1, 1)
DAYS = 100
FUNDS = {"EAST": "F_EAST", "NORTH": "F_NORTH", "SOUTH": "F_SOUTH"}
STOCKS = {"N1": ("NORTH", "boats"), "N2": ("NORTH", "boats"), "N3": ("NORTH", "nets"), "N4": ("NORTH", "nets"), "S1": ("SOUTH", "ports"), "S2": ("SOUTH", "ports"), "S3": ("SOUTH", "sails"), "E1": ("EAST", "buoys"), "NIL": (None, "boats")}
PX = {k.lower(): v for k, v in C.PROXIES.items()}


def made_prices():
    rng = random.Random(11)
    out = []
    for sym in ("SPY", *PX.values(), "F_NORTH", "F_SOUTH", *STOCKS):  # F_EAST has no bars
        close, drift = 50.0, rng.choice([-0.004, 0.0, 0.002, 0.005])
        for k in range(DAYS):
            close *= 1 + drift + rng.gauss(0, 0.004 if sym in ("N1", "S1") else 0.02)
            if (sym == "S3" and k < 70) or (sym == "N3" and k % 9 == 4) or (sym == "F_SOUTH" and k % 13 == 5):
                continue
            high, low = close * (1 + rng.random() / 50), close * (1 - rng.random() / 50)
            volume = float(rng.randint(400_000, 1_600_000)) if sym != "N4" else 1000.0
            out.append((sym, START + dt.timedelta(k), close * 0.999, high, low, close, close * 0.98, volume))
    return out


PRICES = made_prices()
SERIES = [("VIXCLS", "Daily", 18.0, 0.3), ("DGS10", "Daily", 4.0, -0.01), ("T10Y2Y", "Daily", 0.05, -0.02), ("BAMLC0A0CM", "Daily", 1.0, 0.02), ("DTWEXBGS", "Daily", 100.0, 0.2), ("WALCL", "Weekly", 8.0, -0.1), ("CPIAUCSL", "Monthly", 100.0, 0.4), ("UNRATE", "Monthly", 4.0, 0.1), ("PAYEMS", "Monthly", 150.0, -1.0)]


def made_series():
    out = []
    for name, frequency, level, step in SERIES:
        days = {"Daily": 3, "Weekly": 7, "Monthly": 30}[frequency]
        rng = random.Random(name)
        for k in range(-450, DAYS if name != "DTWEXBGS" else 70, days):
            level += rng.choice([-1, 0, 1]) * abs(step) + step / 9
            out.append((name, frequency, START + dt.timedelta(k), level))
    return out


def made_events():
    kinds = ("news", "filing", "earnings")
    return [(n, sym, START + dt.timedelta(day), kinds[n % 3], f"{('8-K', '10-Q')[n % 2]} filed by {sym}") for n, (sym, day) in enumerate((s, d) for s in ("N1", "N2", "S1", "S2") for d in range(58, 104, 5))]


class Plain:
    """Everything of one date from lists of bars."""

    def __init__(self):
        self.bars = defaultdict(list)
        for row in sorted(PRICES):
            self.bars[row[0]].append(row)
        self.dates = [b[1] for b in self.bars["SPY"]][60:]
        self.ranks = {}
        self.days = [self.day(d) for d in self.dates]

    def at(self, sym, date):
        return sum(b[1] <= date for b in self.bars[sym]) - 1

    def ac(self, sym, i):
        return self.bars[sym][i][6]

    def ret(self, sym, date, n):
        i = self.at(sym, date)
        return None if i < n else self.ac(sym, i) / self.ac(sym, i - n) - 1

    def mean(self, sym, date, n):
        i = self.at(sym, date)
        return None if i + 1 < n else statistics.fmean(self.ac(sym, k) for k in range(i - n + 1, i + 1))

    def rv(self, sym, date):
        i = self.at(sym, date)
        return None if i < 20 else self.bars[sym][i][7] / statistics.fmean(b[7] for b in self.bars[sym][i - 20 : i])

    def above(self, sym, date, n):
        m = self.mean(sym, date, n)
        return m is not None and self.ac(sym, self.at(sym, date)) > m

    def at_high(self, sym, date):
        i = self.at(sym, date)
        return i >= 19 and self.ac(sym, i) >= max(self.ac(sym, k) for k in range(i - 19, i + 1))

    def day(self, date):
        zero = lambda x: 0.0 if x is None else x
        clamp = lambda x: min(100.0, max(0.0, x))
        rel = lambda x: clamp(50 + 500 * x)
        spy20, spy60 = zero(self.ret("SPY", date, 20)), zero(self.ret("SPY", date, 60))
        near = {k: zero(self.ret(s, date, 20)) for k, s in PX.items()}
        gap = {k: near[k] - spy20 for k in ("qqq", "iwm", "dia")}
        score = 0.4 * clamp(50 + 400 * spy20 + 160 * spy60) + 0.25 * rel(gap["qqq"]) + 0.25 * rel(gap["iwm"]) + 0.1 * rel(gap["dia"])
        base = "Risk-on" if score >= 60 and spy20 >= 0 and (gap["qqq"] >= 0 or gap["iwm"] >= 0) else "Risk-off" if score <= 40 and spy20 < 0 and spy60 < 0 else "Defensive" if spy20 >= 0 and gap["qqq"] < 0 and gap["iwm"] < 0 else "Mixed"
        context = "Inflation-sensitive" if near["gld"] >= 0.03 and near["uso"] >= 0.03 else "Rate-sensitive" if near["tlt"] <= -0.03 else "Defensive bid" if spy20 < 0 and near["tlt"] >= 0.03 else ""
        out = {"regime": (score, f"{base} / {context}" if context else base), "spy20": spy20}
        share = lambda xs: 100 * sum(xs) / len(xs) if xs else 0.0
        seen = lambda test: [s for s, x in STOCKS.items() if test(x) and self.at(s, date) >= 0]
        sectors = {}
        for sector, fund in FUNDS.items():
            own = seen(lambda x, sector=sector: x[0] == sector)
            b20, b50 = (share([self.above(s, date, n) for s in own]) for n in (20, 50))
            r20, rv = zero(self.ret(fund, date, 20)), self.rv(fund, date)
            rv = 1.0 if rv is None else rv
            total = (0.3 * rel(r20 - spy20) + 0.2 * clamp(50 + 400 * r20) + 0.2 * clamp((rv - 0.5) * 100) + 0.2 * (b20 + b50) / 2) / 0.9
            sectors[sector] = {"score": total, "r20": r20, "components": {"return_5d": zero(self.ret(fund, date, 5)), "return_20d": r20, "relative_volume": rv}}
        order = sorted(FUNDS, key=lambda s: (-sectors[s]["score"], s))
        for k, s in enumerate(order):
            sectors[s] |= {"rank": k + 1, "change": float(self.ranks.get(s, k + 1) - (k + 1))}
            self.ranks[s] = k + 1
        out["sectors"] = sectors
        industries = {}
        for key in {x for x in STOCKS.values() if x[0]}:
            own = seen(lambda x, key=key: x == key)
            means = {n: statistics.fmean(v) if (v := [r for s in own if (r := self.ret(s, date, n)) is not None]) else 0.0 for n in (5, 20, 60)}
            vols = [r for s in own if (r := self.rv(s, date)) is not None]
            b20, b50, high = share([self.above(s, date, 20) for s in own]), share([self.above(s, date, 50) for s in own]), share([self.at_high(s, date) for s in own])
            total = 0.3 * rel(means[20] - sectors[key[0]]["r20"]) + 0.2 * rel(means[20] - spy20) + 0.2 * (b20 + b50) / 2 + 0.15 * clamp(((statistics.fmean(vols) if vols else 1.0) - 0.5) * 100) + 0.15 * high
            industries[key] = {"score": total}
        for k, key in enumerate(sorted(industries, key=lambda x: (-industries[x]["score"], x))):
            industries[key]["rank"] = k + 1
        out["industries"] = industries
        stocks = {}
        for s, (sector, industry) in STOCKS.items():
            i = self.at(s, date)
            bars = self.bars[s]
            adv = statistics.fmean(b[6] * b[7] for b in bars[i - 19 : i + 1]) if i >= 20 else 0.0
            if sector is None or adv < 20e6:
                continue
            r = {n: zero(self.ret(s, date, n)) for n in (1, 5, 20, 60)}
            rv = 1.0 if self.rv(s, date) is None else self.rv(s, date)
            a20, a50 = self.above(s, date, 20), self.above(s, date, 50)
            trend = "above_20d_50d" if a20 and a50 else "above_20d" if a20 else "below_trend"
            total = 0.3 * sectors[sector]["score"] + 0.25 * rel(r[20] - sectors[sector]["r20"]) + 0.2 * clamp((rv - 0.5) * 100) + 0.15 * {"above_20d_50d": 90, "above_20d": 70, "below_trend": 35}[trend] + 0.1 * clamp(adv / 20e6 * 20)
            stocks[s] = {"score": total, "sector": sector, "industry": industry, "trend": trend, "r": r, "rv": rv, "rel_sector": r[20] - sectors[sector]["r20"], "rel_spy": r[20] - spy20, "sector_score": sectors[sector]["score"], **self.structure(s, i, date)}
        for k, s in enumerate(sorted(stocks, key=lambda s: (-stocks[s]["score"], s))):
            stocks[s]["rank"] = k + 1
        out["stocks"] = stocks
        return out

    def structure(self, s, i, date):
        bars = self.bars[s]
        true = [max(b[3] - b[4], abs(b[3] - a[5]), abs(b[4] - a[5])) if a else b[3] - b[4] for a, b in zip([None, *bars], bars, strict=False)]
        gap = bars[i][2] / bars[i - 1][5] - 1 if i else 0.0
        if i < 59:
            return {"complete": False, "gap": gap}
        ac, ma20, ma50 = self.ac(s, i), self.mean(s, date, 20), self.mean(s, date, 50)
        last = lambda n: [self.ac(s, k) for k in range(i - n + 1, i + 1)]
        atr = statistics.fmean(true[i - 13 : i + 1])
        return {"complete": True, "gap": gap, "dist20": ac / ma20 - 1, "dist50": ac / ma50 - 1, "ext20": (ac - ma20) / atr if atr else 0.0, "dist20high": ac / max(last(20)) - 1, "range10": (max(last(10)) - min(last(10))) / ac}


def labels_of(x, catalyst):
    found = []
    if x["complete"]:
        leader = x["rel_sector"] > 0 or x["rel_spy"] > 0
        near = abs(x["dist20"]) <= 0.04 or abs(x["dist50"]) <= 0.06
        r1, r5 = x["r"][1], x["r"][5]
        if r5 >= 0.08 or r1 >= 0.05 or x["gap"] >= 0.04 or x["dist20"] >= 0.12 or x["dist50"] >= 0.2 or x["ext20"] >= 2.5:
            found.append("extended_leader")
        elif leader:
            if -0.12 <= x["dist20high"] <= -0.03 and x["trend"] != "below_trend" and near:
                found.append("pullback_leader")
            if x["range10"] <= 0.08 and x["dist20high"] >= -0.03:
                found.append("base_compression_candidate")
            if 0 < r5 < 0.08 and (near or -0.02 <= x["dist20"] <= 0.08):
                found.append("early_rotation_candidate")
            if (x["score"] >= 70 or x["sector_score"] >= 70) and x["trend"] == "above_20d_50d" and x["dist20"] < 0.12 and x["dist50"] < 0.2 and x["ext20"] < 2.5:
                found.append("actionable_leader")
    if catalyst != "pending_source" and not set(found) - {"extended_leader"}:
        found.append("event_watch_unconfirmed")
    found = found or ["unclassified_leader"]
    return found, next(k for k in ("extended_leader", "pullback_leader", "base_compression_candidate", "early_rotation_candidate", "actionable_leader", "event_watch_unconfirmed", "unclassified_leader") if k in found)


def catalyst_of(sym, date):
    mine = [e for e in made_events() if e[1] == sym]
    news = sum(e[3] == "news" and 0 <= (date - e[2]).days <= 7 for e in mine)
    ahead = [e[2] for e in mine if e[3] == "earnings" and 0 <= (e[2] - date).days <= 30]
    filed = [(e[2], e[0], e[4]) for e in mine if e[3] == "filing" and 0 <= (date - e[2]).days <= 14]
    parts = ([f"recent_news:{news}"] if news else []) + ([f"earnings:{min(ahead)}"] if ahead else []) + ([f"filing:{max(filed)[2].split()[0]}"] if filed else [])
    return " | ".join(parts) or "pending_source"


def flags_of(date):
    seen = defaultdict(list)
    for name, frequency, day, value in sorted(made_series()):
        if day <= date:
            seen[name].append((day, value, frequency))
    now = lambda s, k=1: seen[s][-k][1] if len(seen[s]) >= k else None
    up = lambda s: now(s, 2) is not None and now(s) > now(s, 2)
    down = lambda s: now(s, 2) is not None and now(s) < now(s, 2)
    tests = {"volatility_stress": now("VIXCLS") >= 20, "rate_pressure": up("DGS10"), "yield_curve_inversion": now("T10Y2Y") < 0, "credit_stress": up("BAMLC0A0CM"), "dollar_pressure": up("DTWEXBGS"), "liquidity_tightening": down("WALCL"), "inflation_pressure": now("CPIAUCSL", 13) is not None and now("CPIAUCSL") / now("CPIAUCSL", 13) - 1 >= 0.03, "labor_cooling": up("UNRATE") or down("PAYEMS")}
    stale = sum((date - rows[-1][0]).days > {"Monthly": 45, "Weekly": 14}.get(rows[-1][2], 7) for rows in seen.values())
    return [k for k, v in tests.items() if v], stale


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def market(spark):
    prices = spark.createDataFrame(PRICES, "symbol string, date date, open double, high double, low double, close double, ac double, volume double")
    members = spark.createDataFrame([(s, s, "stock", *x) for s, x in STOCKS.items()], "symbol string, name string, asset_type string, sector string, industry string")
    funds = spark.createDataFrame(list(FUNDS.items()), "sector string, sector_etf string")
    m = backtest.Tested.__new__(backtest.Tested)
    bars = features.bars(prices).persist()
    Market.__init__(m, spark, "", bars=bars, members=members, funds=funds)
    m.events = spark.createDataFrame(made_events(), "event_id long, symbol string, date date, event_type string, headline string")
    m.series = spark.createDataFrame(made_series(), "series string, frequency string, date date, value double")
    m.fwd = backtest.forward(bars)
    kept = {}

    def table(name, build):
        if name not in kept:
            kept[name] = build().persist()
        return kept[name]

    m.table = table
    yield m
    for df in (*kept.values(), bars):
        df.unpersist()


near = lambda x: pytest.approx(x, abs=1e-9)


def test_regime_sector_industry_and_stock_scores(market, plain):
    by_day = dict(zip(plain.dates, plain.days, strict=True))
    got = market.regime().collect()
    assert len(got) == len(plain.dates)
    for r in got:
        assert (r.score, r.label) == (near(by_day[r.score_date]["regime"][0]), by_day[r.score_date]["regime"][1])
    got = market.sectors().collect()
    assert len(got) == len(plain.dates) * len(FUNDS)
    for r in got:
        x = by_day[r.score_date]["sectors"][r.sector]
        assert (r.rank, r.rank_change, r.score, r.r20) == (x["rank"], x["change"], near(x["score"]), near(x["r20"]))
    got = market.industries().collect()
    assert len(got) == len(plain.dates) * 5
    for r in got:
        x = by_day[r.score_date]["industries"][r.sector, r.industry]
        assert (r.rank, r.score) == (x["rank"], near(x["score"]))
    got = market.stock_scores().collect()
    assert {(r.score_date, r.symbol) for r in got} == {(d, s) for d, x in by_day.items() for s in x["stocks"]}
    for r in got:
        x = by_day[r.score_date]["stocks"][r.symbol]
        assert (r.rank, r.trend_state, r.score) == (x["rank"], x["trend"], near(x["score"]))
        if x["complete"]:
            assert r.complete and (r.dist20, r.dist50, r.atr_ext20, r.dist20high, r.range10, r.gap0) == tuple(near(x[k]) for k in ("dist20", "dist50", "ext20", "dist20high", "range10", "gap"))
        else:
            assert not r.complete


def test_catalysts_and_actionability(market, plain):
    by_day = dict(zip(plain.dates, plain.days, strict=True))
    status = {(r.score_date, r.symbol): r.catalyst for r in catalysts(market.stock_scores(), market.events).collect()}
    assert status == {(d, s): catalyst_of(s, d) for d, x in by_day.items() for s in x["stocks"]}
    seen = set()
    for r in market.actions().collect():
        want, primary = labels_of(by_day[r.score_date]["stocks"][r.symbol], status[r.score_date, r.symbol])
        assert (r.labels.split("|"), r.primary) == (want, primary)
        seen |= set(want)
    assert len(seen) >= 6


def test_macro_flags(market, plain):
    got = {r.score_date: (r.flags, r.n_stale) for r in macro_flags(macro_asof(market.series, market.dates), market.dates).collect()}
    want = {d: flags_of(d) for d in plain.dates}
    assert got == {d: ("|".join(f), n) for d, (f, n) in want.items()}
    assert len({f for f, _ in got.values()}) > 2 and any(n for _, n in got.values())


def test_watchlist_labels(market, plain):
    top = {d: [s for s, v in x["stocks"].items() if v["rank"] <= C.WATCHLIST] for d, x in zip(plain.dates, plain.days, strict=True)}
    want = {}
    for k, (d, x) in enumerate(zip(plain.dates, plain.days, strict=True)):
        flags = flags_of(d)[0]
        low = x["regime"][1].lower().replace("-", "_")
        conflict = ("risk_on" in low and bool(flags)) or (any(w in low for w in ("defensive", "mixed", "risk_off")) and not flags)
        before = top[plain.dates[k - 1]] if k else []
        for s in top[d]:
            v, c = x["stocks"][s], catalyst_of(s, d)
            tests = {"sector_leader": x["sectors"][v["sector"]]["rank"] <= 3, "industry_leader": x["industries"][v["sector"], v["industry"]]["rank"] <= 10, "relative_strength_leader": v["rel_sector"] > 0 and v["rel_spy"] > 0, "volume_confirmed": v["rv"] >= 1.2, "new_leader": bool(before) and s not in before, "event_context": c != "pending_source", "event_risk": "earnings:" in c or "filing:" in c, "macro_conflict_context": conflict}
            want[d, s] = "|".join(n for n, t in tests.items() if t)
    assert {(r.score_date, r.symbol): r.labels for r in market.watch().collect()} == want


def observations(plain):
    """(entity, horizon, decile): [(ret, relative, vs_spy, vs_sector)] of sectors, one component and stocks."""
    ahead = lambda s, d, h: plain.ac(s, i + h) / plain.ac(s, i) - 1 if (i := plain.at(s, d)) >= 0 and plain.bars[s][i][1] == d and i + h < len(plain.bars[s]) else None
    tenth = lambda k, n: math.ceil((k + 1) * 10 / n)
    out = defaultdict(list)
    for d, x in zip(plain.dates, plain.days, strict=True):
        rank = {s: v["rank"] for s, v in x["sectors"].items()}
        for entity, value in (("sector", lambda s: x["sectors"][s]["score"]), ("sector_component_relative_volume", lambda s: x["sectors"][s]["components"]["relative_volume"])):  # noqa: B023
            for k, s in enumerate(sorted(FUNDS, key=lambda s: (value(s), rank[s]))):  # noqa: B023
                for h in (1, 5, 10, 20, 60):
                    own, spy = ahead(FUNDS[s], d, h), ahead("SPY", d, h)
                    if own is not None and spy is not None:
                        out[entity, h, tenth(k, len(FUNDS))].append((own, own - spy, own - spy, None))
        for k, s in enumerate(sorted(x["stocks"], key=lambda s: (x["stocks"][s]["score"], x["stocks"][s]["rank"]))):
            for h in (1, 5, 10, 20, 60):
                own, fund, spy = ahead(s, d, h), ahead(FUNDS[x["stocks"][s]["sector"]], d, h), ahead("SPY", d, h)
                if None not in (own, fund, spy):
                    out["stock", h, tenth(k, len(x["stocks"]))].append((own, own - fund, own - spy, own - fund))
    return out


def test_backtest_summary(market, plain):
    want = observations(plain)
    rows = backtest.grouped(market.observations(), "entity, horizon, decile", "relative", backtest.MEASURES).collect()
    got = {(r.entity, r.horizon, r.decile): r for r in rows if r.entity in ("sector", "sector_component_relative_volume", "stock")}
    assert set(got) == set(want)
    for key, found in want.items():
        r = got[key]
        assert (r.n, r.hit_rate) == (len(found), pytest.approx(sum(x[1] > 0 for x in found) / len(found), abs=2e-6))
        for k, name in enumerate(backtest.MEASURES):
            values = [x[k] for x in found if x[k] is not None]
            assert r[f"mean_{name}"] == pytest.approx(statistics.fmean(values) if values else -9.0, abs=2e-6)
            assert r[f"median_{name}"] == pytest.approx(statistics.median(values) if values else -9.0, abs=2e-6)


def test_groups_of_events_and_labels(market, plain):
    """The summaries by catalyst group and by label count what plain grouping counts."""
    ahead = lambda s, d, h: (i := plain.at(s, d)) >= 0 and plain.bars[s][i][1] == d and i + h < len(plain.bars[s])
    events, actions = defaultdict(int), defaultdict(int)
    for d, x in zip(plain.dates, plain.days, strict=True):
        for s, v in x["stocks"].items():
            c = catalyst_of(s, d)
            has = {k: f"{k}:" in c for k in ("recent_news", "earnings", "filing")}
            groups = ["all_watchlist"] + (["pending_source"] if c == "pending_source" else ["event_context", *(k for k, y in has.items() if y)] + (["event_risk"] if has["earnings"] or has["filing"] else []) + (["multiple_event_types"] if sum(has.values()) >= 2 else []))
            found, primary = labels_of(v, c)
            for h in (1, 5, 10, 20, 60):
                if all(ahead(t, d, h) for t in (s, FUNDS[v["sector"]], "SPY")):
                    for g in groups:
                        events[g, h] += 1
                    for g in {"all_watchlist", primary, *found}:
                        actions[g, h] += 1
    count = lambda df: {(r.grp, r.horizon): r.n for r in backtest.grouped(df, "grp, horizon", "vs_sector", ("ret",)).collect()}
    assert count(market.event_rows()) == dict(events)
    assert count(market.action_rows()) == dict(actions)
