"""Stores by month, landed feeds, failures, screener pages, state between runs."""

import datetime as dt
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tidewheel.operators import merge, schema, store
from tidewheel.plans import runs
from tidewheel.plans.labels import Labelled
from tidewheel.sources import landed, provider, tables

SF = "/root/testdata/sf0.001"
DAY = dt.date(2031, 1, 30)
PRICES = "symbol string, date date, close double"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/month=*/*.parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- writes by key and by range ------------------------------------------------------


def test_merge_writes_only_the_months_it_touches(spark, tmp_path):
    path = str(tmp_path / "prices")
    first = [("A", DAY + dt.timedelta(k), float(k)) for k in range(0, 90, 10)] + [("B", None, 7.0)]
    merge.merge(spark, path, spark.createDataFrame(first, PRICES), ["symbol", "date"])
    before = files(path)
    second = [("A", DAY + dt.timedelta(10), 50.0), ("A", DAY + dt.timedelta(11), 51.0), ("C", DAY + dt.timedelta(200), 9.0)]
    assert merge.merge(spark, path, spark.createDataFrame(second, PRICES), ["symbol", "date"]) == [203102, 203108]
    after = files(path)
    assert {f for f in before if "month=203102" not in f} <= set(after) and all(after[f] == before[f] for f in before if "month=203102" not in f)
    assert not {f for f in before if "month=203102" in f} & set(after)
    want = {r[:2]: r for r in first} | {r[:2]: r for r in second}
    assert rows(merge.read(spark, path).select("symbol", "date", "close")) == sorted(want.values(), key=str)
    assert not glob.glob(f"{path}.staged/*")
    assert merge.merge(spark, path, spark.createDataFrame([], PRICES), ["symbol", "date"]) == [] and files(path) == after


def test_reads_of_days_prune_months(spark, tmp_path):
    path = str(tmp_path / "prices")
    merge.write(spark.createDataFrame([("A", DAY + dt.timedelta(k), float(k)) for k in range(90)], PRICES), path)
    part = merge.read(spark, path, "2031-02-10", "2031-03-02")
    assert part.count() == 21
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in scan and "month#" in scan.split("PartitionFilters")[1].split("]")[0]
    assert {r[0].split("month=")[1][:6] for r in part.select(F.input_file_name()).collect()} == {"203102", "203103"}
    assert merge.read(spark, path, before="2031-02-01").count() == 2


def test_events_move_between_months_and_empty_months_go(spark, tmp_path):
    path = str(tmp_path / "events")
    kind = "source string, source_event_id string, date date, headline string"
    merge.merge(spark, path, spark.createDataFrame([("f", "1", DAY, "old"), ("f", "2", DAY + dt.timedelta(40), "stays")], kind), store.KEYS["events"])
    new = [("f", "1", DAY + dt.timedelta(40), "moved"), ("f", "", DAY, "no id"), ("f", None, DAY, "null id"), ("g", "1", DAY + dt.timedelta(40), "other source")]
    assert merge.merge(spark, path, spark.createDataFrame(new, kind), store.KEYS["events"]) == [203101, 203103]
    assert sorted(r.headline for r in merge.read(spark, path).collect()) == ["moved", "other source", "stays"]
    assert not os.path.exists(f"{path}/month=203101")


def test_replaced_news_leave_other_events(spark, tmp_path):
    path = str(tmp_path / "events")
    kind = "source string, event_type string, date date, headline string"
    held = [("alpaca_news:x", "news", DAY, "gone"), ("alpaca_news:x", "news", DAY - dt.timedelta(40), "earlier"), ("rss:x", "news", DAY, "other source"), ("alpaca_news:x", "filing", DAY, "no news"), (None, "news", DAY, "no source")]
    merge.write(spark.createDataFrame(held, kind), path)
    merge.replace_news(spark, path, spark.createDataFrame([("alpaca_news:x", "news", DAY, "new"), ("alpaca_news:x", "news", DAY, "new")], kind), "2031-01-25", "2031-01-31")
    assert sorted(r.headline for r in merge.read(spark, path).collect()) == ["earlier", "new", "new", "no news", "no source", "other source"]


def test_a_write_that_was_cut_off_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "prices")
    merge.merge(spark, path, spark.createDataFrame([("A", DAY, 1.0), ("B", DAY, 2.0)], PRICES), ["symbol", "date"])

    def cut(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(merge, "_apply", cut)
        with pytest.raises(KeyboardInterrupt):
            merge.merge(spark, path, spark.createDataFrame([("A", DAY, 5.0)], PRICES), ["symbol", "date"])
    os.makedirs(f"{path}.staged/broken/rows")
    assert rows(merge.read(spark, path).select("symbol", "close")) == [("A", 1.0), ("B", 2.0)]
    assert merge.recover(spark, path) == 1
    assert rows(merge.read(spark, path).select("symbol", "close")) == [("A", 5.0), ("B", 2.0)]
    assert merge.recover(spark, path) == 0 and not glob.glob(f"{path}.staged/*")


def test_replace_by_sector_and_appended_runs(spark, tmp_path):
    path = str(tmp_path / "screens")
    kind = "ticker string, sector string"
    store.replace_partitions(spark.createDataFrame([("A", "Energy"), ("B", "Energy"), ("C", "Tech")], kind), path, "sector")
    store.replace_partitions(spark.createDataFrame([("D", "Energy")], kind), path, "sector")
    assert rows(spark.read.parquet(path)) == [("C", "Tech"), ("D", "Energy")]
    log = str(tmp_path / "runs")
    ids = [store.append_run(spark, log, f"run {k}", "2031-01-01", "2031-02-01", spark.createDataFrame([(k, 0.5)], "n int, rate double")) for k in range(2)]
    assert sorted((r.run_id, json.loads(r.metrics_json)["n"]) for r in spark.read.parquet(log).collect()) == sorted(zip(ids, range(2), strict=True))
    out = str(tmp_path / "csv")
    store.export_csv(spark.createDataFrame([("a,b", None), ('q"', 2)], "t string, n int"), out)
    (one,) = glob.glob(f"{out}/*.csv")
    assert rows(spark.read.option("header", True).option("escape", '"').csv(out)) == [("a,b", None), ('q"', "2")] and open(one).readline() == "t,n\n"


def test_first_of_takes_the_order_and_not_the_row(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, None), ("a", 3, "z")], "k string, n int, v string").repartition(3)
    assert rows(store.first_of(df, ["k"], "n")) == [("a", 1, "x"), ("b", 5, None)]
    assert rows(store.first_of(df, ["k"], "n", last=True)) == [("a", 3, "z"), ("b", 5, None)]
    again = spark.createDataFrame([("a", 9, "late"), ("c", 1, "only")], "k string, n int, v string")
    assert rows(runs.union_first([df, again], ["k"], "n")) == [("a", 1, "x"), ("b", 5, None), ("c", 1, "only")]


# ---- schema versions -----------------------------------------------------------------


def test_older_files_are_widened(spark, tmp_path):
    path = str(tmp_path / "macro")
    old = spark.createDataFrame([("S", DAY, 1.0, "f")], schema.declared("macro_series", 1))
    old.write.parquet(path)
    assert schema.version_of(spark, "macro_series", path) == 1
    schema.widen(old.withColumn("quality_status", F.lit("late")), "macro_series").write.mode("append").parquet(path)
    assert schema.version_of(spark, "macro_series", path) == 2
    got = schema.read(spark, "macro_series", path)
    assert got.schema.simpleString() == schema.widen(old, "macro_series").schema.simpleString()
    assert rows(got.select("quality_status", "raw_json", "units")) == [("late", "{}", ""), ("ok", "{}", "")]
    out = str(tmp_path / "new")
    schema.migrate(spark, "macro_series", path, out)
    once = rows(schema.read(spark, "macro_series", out))
    schema.migrate(spark, "macro_series", out, str(tmp_path / "again"))
    assert rows(schema.read(spark, "macro_series", str(tmp_path / "again"))) == once == rows(got)
    assert schema.version_of(spark, "events", out) == 0


# ---- screener pages --------------------------------------------------------------------


CELLS = [str(k) for k in range(14)]
LINK = "<a class='company-ticker'><span>A</span></a><a href='#' class='tab-link big'> ORCA&amp;1 </a>"


def row(cells, close="</td>", end="</tr>", name="styled-row x"):
    return f"<tr class='{name}'>" + "".join(f"<td>{c}{close}" for c in cells) + end


def test_screener_rows():
    table = lambda body: f"<table class='a'><tr class='styled-row'><td>no</td></tr></table><table class='b screener_table'>{body}</table>"
    cells = [CELLS[0], LINK, *CELLS[2:]]
    assert tables.rows_of(table(row(cells)), 14) == [([CELLS[0], "A ORCA&1", *CELLS[2:]], "ORCA&1")]
    assert tables.rows_of(table(row(CELLS)), 14) == [(CELLS, "1")]
    broken = tables.rows_of(table(row(CELLS, "", "") + row(CELLS, "", "")), 14)
    assert broken == [(CELLS, "1")] * 2
    assert tables.rows_of(table(row(CELLS, "", "")).removesuffix("</table>"), 14) == [(CELLS, "1")]  # the text ends early
    assert tables.rows_of(table(row(CELLS[:13]) + row(CELLS, name="head")), 14) == []
    nested = table(row([*CELLS[:13], "x<table><tr class='styled-row'><td>y</td></tr></table>z"]) + row(CELLS))
    assert [c[-1] for c, _ in tables.rows_of(nested, 14)] == ["xyz", "13"]
    assert tables.rows_of(None, 1) == tables.rows_of("", 1) == tables.rows_of("<table>" + row(CELLS), 1) == []
    two = table(row(CELLS)) + "<table class='screener_table'>" + row(CELLS) + "</table>"
    assert len(tables.rows_of(two, 14)) == 1


def test_table_function_joins_pages(spark):
    page = "<table class='screener_table'>" + row(["1", LINK, "Orca Boats", "Sea", "Hulls", "NO", "1.5B", "-", "12.50", "-1.25%", "1,204"]) + "</table>"
    pages = spark.createDataFrame([(1, page, "x"), (2, None, "y"), (3, page * 2, "z")], "page long, html string, ticker_ string")
    got = tables.table_rows(pages, "overview").select("page", "row", "ticker", "company", tables.number("market_cap"), tables.number("pe"), tables.number("change"), tables.number("volume"))
    assert rows(got) == [(p, 0, "ORCA&1", "Orca Boats", 1.5e9, None, -1.25, 1204.0) for p in (1, 3)]


# ---- landed feeds ----------------------------------------------------------------------


def test_ticker_map(spark):
    text = '{"0": {"cik_str": 7, "ticker": "orca", "title": "Orca"}, "1": {"cik_str": 8, "ticker": "A-B", "title": "Ab"}, "2": {"cik_str": 9, "ticker": "Orca", "title": "Orca again"}, "3": {"ticker": "NONE"}}'
    companies = landed.tickers(spark.createDataFrame([(text,)], "json string"))
    asked = spark.createDataFrame([("A.B", 1), ("Orca", 2), ("A-B", 3), ("TERN", 4)], "symbol string, n int")
    assert rows(landed.with_cik(asked, companies)) == [("A-B", 3, 8, "Ab"), ("A.B", 1, 8, "Ab"), ("Orca", 2, 9, "Orca again")]
    both = landed.tickers(spark.createDataFrame([('{"0": {"cik_str": 1, "ticker": "X.Y", "title": "dot"}, "1": {"cik_str": 2, "ticker": "X-Y", "title": "dash"}}',)], "json string"))
    assert rows(landed.with_cik(spark.createDataFrame([("X.Y",)], "symbol string"), both)) == [("X.Y", 1, "dot")]


def test_news_are_kept_for_requested_symbols(spark):
    text = json.dumps({"news": [{"id": 5, "headline": "h", "url": "u", "created_at": "2031-03-03T23:59:00Z", "symbols": ["ORCA", "TERN", "ORCA"]}, {"id": 6, "headline": "no symbols", "url": None, "created_at": "2031-03-03T00:00:00Z", "symbols": []}]})
    asked = spark.createDataFrame([("ORCA",), ("ORCA",)], "symbol string")
    got = landed.news(spark.createDataFrame([(text,), (None,), ("{",)], "json string"), asked)
    assert {(r.symbol, str(r.date), r.source_event_id) for r in got.collect()} == {("ORCA", "2031-03-03", "5")}


def test_the_data_source_has_a_partition_for_each_file(spark, tmp_path):
    for name, values in {"RAIN": ["1.5", "."], "SNOW": ["-2"]}.items():
        os.makedirs(tmp_path / "macro" / f"series={name}")
        (tmp_path / "macro" / f"series={name}" / "a.txt").write_text(json.dumps({"observations": [{"date": f"2031-02-0{k + 1}", "value": v} for k, v in enumerate(values)]}))
    (tmp_path / "macro" / "_SUCCESS").write_text("x")
    p = provider.LandedProvider(spark, f"file://{tmp_path}")
    macro = p.macro_observations("2031-02-28")
    assert rows(macro) == [("RAIN", dt.date(2031, 2, 1), 1.5), ("SNOW", dt.date(2031, 2, 1), -2.0)]
    assert macro.rdd.getNumPartitions() == 2
    assert p.macro_observations("2031-01-31").count() == 0
    os.makedirs(tmp_path / "intraday" / "5Min")
    bar = lambda t: {"t": t, "o": 1, "h": 2, "l": 1, "c": 2, "v": 9, "vw": 1.5}
    (tmp_path / "intraday" / "5Min" / "x.json").write_text(json.dumps({"bars": {"ORCA": [bar("2031-02-03T15:00:00Z"), bar("2031-02-04T15:00:00Z")], "TERN": None}}))
    got = p.intraday_prices(spark.createDataFrame([("ORCA",)], "symbol string"), "2031-02-03", "5Min").collect()
    assert [(r.symbol, r.timeframe, r.vwap, str(r.ts)) for r in got] == [("ORCA", "5Min", 1.5, "2031-02-03 15:00:00")]


class Feed:
    """A provider whose sources can be told to fail or to be empty."""

    def __init__(self, spark, failing=(), empty=()):
        self.spark, self.failing, self.empty = spark, failing, empty

    def give(self, name, rows, kind):
        if name in self.empty:
            rows = []
        df = self.spark.createDataFrame(rows, kind)
        return df.withColumn("boom", F.raise_error(F.lit("late failure")).cast("string")) if name in self.failing else df

    def universe(self):
        if "universe" in self.failing:
            raise ConnectionError("no route")
        return self.give("universe", [("ORCA",)], "symbol string")

    def daily_prices(self, symbols, end):
        return self.give("prices", [("ORCA", 1.0)], "symbol string, close double").join(symbols, "symbol", "left_semi")

    def macro_observations(self, end):
        return self.give("macro", [("RAIN", 1.0)], "series string, value double")

    def recent_news(self, symbols, end):
        return self.give("news", [("ORCA", DAY, "news", "1")], provider.EVENTS)

    def upcoming_earnings(self, symbols):
        return self.give("earnings", [("ORCA", DAY, "earnings", "2")], provider.EVENTS)

    def recent_filings(self, symbols, end):
        return self.give("filings", [("ORCA", DAY, "filing", "3")], provider.EVENTS)


LAST = "symbol string, is_active boolean"


def test_event_sources_degrade_to_nothing_with_a_warning(spark):
    got = provider.gather(spark, Feed(spark, failing=("news", "filings")), "2031-02-01")
    assert (got.news.count(), got.earnings.count(), got.filings.count(), got.prices.count()) == (0, 1, 0, 1)
    assert got.news.columns == ["symbol", "date", "event_type", "source_event_id"]
    warned = {r.source: r.warning for r in got.warnings().collect()}
    assert set(warned) == {"news", "filings"} and "continuing without news context" in warned["news"] and "late failure" in warned["news"]
    assert provider.gather(spark, Feed(spark, empty=("news",)), "2031-02-01").warnings().count() == 0


def test_the_universe_falls_back_to_active_symbols(spark):
    last = spark.createDataFrame([("ORCA", True), ("GONE", False)], LAST)
    got = provider.gather(spark, Feed(spark, failing=("universe",)), "2031-02-01", last)
    assert rows(got.symbols) == [("ORCA",)] and "using 1 active symbols" in got.warnings().first().warning
    for stored in (None, last.filter("not is_active")):
        with pytest.raises(provider.NoData):
            provider.gather(spark, Feed(spark, failing=("universe",)), "2031-02-01", stored)


@pytest.mark.parametrize("name", ["prices", "macro"])
def test_prices_and_macro_observations_end_the_run(spark, name):
    with pytest.raises(provider.NoData):
        provider.gather(spark, Feed(spark, empty=(name,)), "2031-02-01")
    with pytest.raises(Exception, match="late failure"):
        provider.gather(spark, Feed(spark, failing=(name,)), "2031-02-01")


# ---- state between runs ----------------------------------------------------------------


def test_kept_catalysts(spark, tmp_path):
    path = str(tmp_path / "statuses")
    kind = "score_date date, symbol string, catalyst string"
    d1, d2, d3 = (DAY + dt.timedelta(k) for k in range(3))
    runs.run_catalysts(spark, path, spark.createDataFrame([(d1, "A", "recent_news:2"), (d1, "B", "pending_source"), (d2, "A", "filing:8-K")], kind))
    runs.run_catalysts(spark, path, spark.createDataFrame([(d1, "A", "pending_source"), (d1, "B", "earnings:x"), (d2, "A", "pending_source"), (d3, "A", "pending_source")], kind))
    got = {(r.score_date, r.symbol): r.catalyst for r in merge.read(spark, path, by="score_date").collect()}
    assert got == {(d1, "A"): "recent_news:2", (d1, "B"): "earnings:x", (d2, "A"): "filing:8-K", (d3, "A"): "pending_source"}
    runs.run_catalysts(spark, path, spark.createDataFrame([(d2, "A", "pending_source")], kind))  # the report's own day is always new
    assert {r.catalyst for r in merge.read(spark, path, by="score_date").filter(F.col("score_date") == F.lit(d2)).collect()} == {"pending_source"}


@pytest.mark.parametrize(
    ("text", "labels", "primary", "complete"),
    [
        (None, "unclassified_leader", "unclassified_leader", False),
        ("", "unclassified_leader", "unclassified_leader", False),
        ("[1]", "unclassified_leader", "unclassified_leader", False),
        ('{"actionability_labels": []}', "unclassified_leader", "unclassified_leader", False),
        ('{"actionability_labels": ["pullback_leader", "extended_leader"]}', "pullback_leader|extended_leader", "extended_leader", False),
        ('{"actionability_labels": "pullback_leader", "primary_actionability": "x"}', "unclassified_leader", "x", False),
        ('{"distance_from_20d_ma_pct": 0.1, "distance_from_50d_ma_pct": 0.1, "atr_extension_from_20d_ma": 1, "distance_from_20d_high_pct": 0, "range_10d_pct": 0.5}', "unclassified_leader", "unclassified_leader", True),
        ('{"distance_from_20d_ma_pct": "wide", "distance_from_50d_ma_pct": 0.1, "atr_extension_from_20d_ma": 1, "distance_from_20d_high_pct": 0, "range_10d_pct": 0.5}', "unclassified_leader", "unclassified_leader", False),
    ],
)
def test_stored_components(spark, text, labels, primary, complete):
    r = runs.read_components(spark.createDataFrame([(text,)], "components_json string")).first()
    assert (r.labels, r.primary, r.complete) == (labels, primary, complete)
    assert r.dist50 == (0.1 if complete or "wide" in (text or "") else 0.0)


def test_snapshot_files_hold_each_day(spark, tmp_path):
    m = Labelled(spark, SF)
    screened = spark.createDataFrame([("A", "Energy"), ("B", "Tech")], "ticker string, sector string")
    runs.export(m, str(tmp_path), screened)
    (dates,) = [json.loads(open(f).read()) for f in glob.glob(f"{tmp_path}/dates/*.txt")]
    days = sorted(f.split("=")[1] for f in glob.glob(f"{tmp_path}/dashboard/score_date=*"))
    assert dates["dates"] == days[::-1] and len(days) == m.dates.count()
    (latest,) = [json.loads(open(f).read()) for f in glob.glob(f"{tmp_path}/latest/*.txt") if os.path.getsize(f)]
    assert latest["score_date"] == days[-1] and latest["watchlist"][0]["rank"] == 1 and latest["stocks"]
    texts = [open(f).read().splitlines() for f in glob.glob(f"{tmp_path}/dashboard/score_date={days[0]}/*.txt")]
    assert len(texts) == 1 and len(texts[0]) == 1
    assert sorted(os.listdir(f"{tmp_path}/screener"))[-2:] == ["sector=Energy", "sector=Tech"]
